import re

import numpy as np
from pyspark.sql import Row

from sightline.llm import decontaminate as D
from tests.compare import rows


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for _i, t in docs:
        w, hit, got = words(t), set(), []
        for k, b in items:
            x = words(b)
            n = min(len(x), 13)
            grams = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            found = [j for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in grams] if n else []
            hit.update(p for j in found for p in range(j, j + n))
            if found:
                got.append(k)
        out.append((len(w), len(hit), sorted(got)))
    return out


def test_suffix_array_and_search():
    rng = np.random.default_rng(3)
    t = rng.integers(1, 4, 300)
    t[100:180] = t[:80]
    index = D.FMIndex(t)
    for k in (1, 2, 5, 13):
        pats = np.array([t[i : i + k] for i in range(0, 280, 7)] + [[s] * k for s in range(4, 19)])
        lo, hi = index.search(pats, np.full(len(pats), k))
        for p, a, b in zip(pats, lo, hi, strict=True):
            want = [i for i in range(len(t) - k + 1) if (t[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(n))) for i, n in enumerate([20, 5, 1, 13, 14, 40])] + [(90, None), (91, "..."), (92, "x y")]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 60, 40))]
    docs += [(50, None), (51, ""), (52, "?!"), (53, "A " + items[5][1].upper() + " b"), (54, items[0][1].replace(" ", "...\n")), (55, "x y " * 30_000), (55, "x y " * 30_000), (None, "x-Y")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", __import__("pyspark").sql.functions.lit("mine"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(d, b, keep=["doc_id", "n_words"]).collect()
    assert [(r.n_words, r.n_hit, sorted(r.item_ids)) for r in got] == brute(docs, items)
    assert all(r.in_n_words == "mine" for r in got)
    for r in got:
        assert sum(s.end - s.first for s in r.spans) == r.n_hit
        assert all(a.end < z.first for a, z in zip(r.spans, r.spans[1:], strict=False))


def test_parts_of_the_benchmark_agree(spark):
    b = spark.createDataFrame([(i, f"a b c d{i} e f") for i in range(30)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"x a b c d{i} e f y") for i in range(40)], "doc_id long, text string")
    one = D.find_contamination(d, b).toPandas()
    many = D.find_contamination(d, b, part_bytes=40).toPandas()
    assert rows(one.drop(columns="spans")) == rows(many.drop(columns="spans"))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.find_contamination(d.limit(0), b).count() == 0
    assert D.find_contamination(d, b.limit(0)).collect() == [Row(doc_id=1, n_words=2, n_hit=0, spans=[], item_ids=[])]


def test_a_tiny_shard_and_a_large_vocabulary(spark):
    """A shard shorter than the symbols that one key packs."""
    b = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(4000))), (2, "lone")], "item_id long, text string")
    d = spark.createDataFrame([(1, "lone")], "doc_id long, text string").repartition(1)
    r = D.find_contamination(d, b).first()
    assert (r.n_words, r.n_hit, r.item_ids) == (1, 1, [2])
    for n in (1, 2, 3):
        t = np.arange(n, 0, -1)
        assert D.suffix_array(np.append(t + 60_000, 0)).tolist() == list(range(n, -1, -1))


def test_rows_of_one_item(spark):
    """Rows that share an id are one item, in one part or in several; null ids are one item, too."""
    long = " ".join(f"w{i}" for i in range(15))
    b = spark.createDataFrame([(1, long), (1, long), (2, "q r " + long), (None, "z z"), (None, "y y"), (1, "only here")], "item_id long, text string").coalesce(1)
    d = spark.createDataFrame([(1, long), (2, "z z, y y"), (3, "only here")], "doc_id long, text string")
    for part_bytes in (1 << 20, 1):
        got = {r.doc_id: r for r in D.find_contamination(d, b, part_bytes=part_bytes).collect()}
        assert got[1].item_ids == [1, 2] and got[2].item_ids == [None] and got[3].item_ids == [1]
        assert [(s.first, s.end) for s in got[2].spans] == [(0, 4)] and got[1].n_hit == 15
