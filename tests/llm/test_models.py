"""The classifiers: held-out accuracy, bounded samples, odd texts; and the pipeline."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from sightline.llm import mixture, quality, simhash, toxicity
from sightline.llm.frames import written
from sightline.llm.sample import fold, labelled
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import brute as fingerprint
from tests.llm.test_simhash import roots
from tests.llm.test_substrings import brute as without_repeats

BIG = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("op", "label", "mod", "rest"), [(quality.op7_quality_classifier, "quality", 4, 2), (toxicity.op9_toxicity, "toxic", 5, 0)])
def test_held_out(spark, op, label, mod, rest):
    got = op(spark, BIG).toPandas()
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % mod == rest for i in got.doc_id]).all()
    lab = spark.read.parquet(f"{BIG}/labels.parquet").toPandas()
    held = got.merge(lab, on="doc_id").query("held_out")
    assert (held.predicted == held[label]).mean() > 0.97


def test_held_out_labels_are_never_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a.w, b.w) and a.threshold == b.threshold
    texts, y = labelled(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2, most={0: (5, 5000), 1: (5, 5000)})
    assert 0 < len(texts) <= 10 and len(texts) == len(y)


def test_odd_texts(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, " \n\n"), (3, "É"), (4, "idiot " * 50_000), (5, "𝄞|\x0b!")], "doc_id long, text string").selectExpr("*", "'mine' as score")
    for scored in (quality.score_quality(odd, quality.fit(docs, labels), keep=["doc_id", "score"]), toxicity.score_toxicity(odd, toxicity.fit(docs, labels), keep=["doc_id", "score"]), quality.score_quality(odd, None, keep=["doc_id", "score"]), toxicity.score_toxicity(odd, None, keep=["doc_id", "score"])):
        got = scored.collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 and r.in_score == "mine" for r in got)
        assert scored.limit(0).count() == 0
    assert quality.fit(docs, labels.limit(0)) is None and toxicity.fit(docs.limit(0), labels) is None


def test_spans(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{BIG}/labels.parquet"))
    text = "Été, the worthless idiot of it. And on the of"
    r = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    found = " ".join(text[s.start : s.end] for s in r.spans)
    assert "worthless" in found and "idiot" in found and "Été" not in found


def enumerated(e, t, start):
    n, total, want, both = len(e), 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for k in range(2**n):
        tags = [(k >> i) & 1 for i in range(n)]
        s = np.exp(start * tags[0] + sum(e[i] for i in range(n) if tags[i]) + sum(t[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        total += s
        want += s * np.array(tags)
        for a, b in zip(tags, tags[1:], strict=False):
            both[a, b] += s
    return want / total, both / total


def test_forward_backward_against_enumeration():
    """Chains of several blocks, and chains in which all tokens look alike."""
    rng = np.random.default_rng(0)
    t, start, counts = rng.normal(size=(2, 2)), 0.3, np.array([5, 9, 1, 3, 8])
    e = rng.normal(size=counts.sum())
    off = np.cumsum(counts) - counts
    want = [enumerated(e[o : o + n], t, start) for o, n in zip(off, counts, strict=True)]
    for step in (3, 32):
        b = toxicity.Blocks(counts, step)
        table = np.zeros(len(b.first) * step)
        table[b.place(np.arange(len(e)))] = e
        p, pairs = toxicity.forward_backward(table.reshape(-1, step), b, t, start)
        assert np.allclose(p[b.inside()], np.concatenate([w[0] for w in want]))
        assert np.allclose(pairs, sum(w[1] for w in want))
    ahead, back = toxicity.plain_ratios(np.exp(-0.7), t, start, 50)
    for n in (1, 2, 7):
        odds = ahead[:n] * back[:n][::-1]
        assert np.allclose(odds / (1 + odds), enumerated(np.full(n, -0.7), t, start)[0])


def test_whole_texts_are_one_chain(spark):
    """The marginals of a long text equal those of one plain pass over all its tokens."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{BIG}/labels.parquet"))
    text = " ".join(["the of it", "worthless idiot", "and so on " * 40, "idiot", "of " * 70] * 3)
    w = toxicity.tokens(__import__("pyarrow").array([text, "of it", "", "idiot"]))
    got = model.marginals(w)
    row, col = model.active(w)
    e = np.bincount(row, model.w[col], len(w)) + model.bias
    for d in range(4):
        x = e[w.word_off[d] : w.word_off[d + 1]]
        m, a, alphas = np.exp(model.t), None, []
        for v in x:
            a = np.array([1.0, np.exp(model.start)]) if a is None else a @ m
            a = a * [1, np.exp(v)]
            a /= a.sum()
            alphas.append(a)
        b, want = np.ones(2), []
        for k in range(len(x) - 1, -1, -1):
            p = alphas[k] * b
            want.append(p[1] / p.sum())
            b = m @ (b * [1, np.exp(x[k])])
            b /= b.sum()
        assert np.allclose(got[w.word_off[d] : w.word_off[d + 1]], want[::-1], atol=1e-9)


def test_sample_passes_over_a_long_text(spark):
    docs = spark.createDataFrame([(i, "x" * (10_000 if i == 3 else 50)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    texts, y = labelled(docs, labels, "toxic", F.lit(True), most={0: (20, 2000), 1: (20, 2000)})
    assert len(texts) == 19 and max(map(len, texts)) == 50 and sum(y) == 9


def test_pipeline(spark, sf):
    """Every stage against a plain version on the same input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "mixing sources to target weights"]
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.toPandas()
        now = written(stage(spark, now, sf), "test")
        after = now.toPandas()
        if k < 4:
            assert now.columns == docs.columns
        if k == 0:
            s = quality.score_quality(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).toPandas()
            assert set(after.doc_id) == set(s[s.score >= 0.7].doc_id)
        elif k == 1:
            f = {i: fingerprint(t) for i, t in zip(before.doc_id, before.text, strict=True)}
            near = [(a, b) for a in f for b in f if a < b and bin(f[a] ^ f[b]).count("1") <= 3]
            assert sorted(after.doc_id) == sorted(set(roots(f, near).values()))
        elif k == 2:
            want = {i: (w if w[1] else (0, 0, t)) for i, t, w in zip(before.doc_id, before.text, without_repeats(before.text, 35), strict=True)}
            assert {i: t for i, t in zip(after.doc_id, after.text, strict=True)} == {i: w[2] for i, w in want.items()}
            assert (after.n_chars == after.text.str.len()).all()
        elif k == 3:
            hits = contaminated(list(zip(before.doc_id, before.text, strict=True)), bench)
            assert sorted(after.doc_id) == sorted(i for i, (n, h, _) in zip(before.doc_id, hits, strict=True) if not (h and 20 * h >= n))
        else:
            want = mixture.mix(spark.createDataFrame(before)).where("taken > 0").toPandas()
            assert sorted(zip(after.doc_id, after.taken, strict=True)) == sorted(zip(want.doc_id, want.taken, strict=True))
    assert corpus_pipeline.run(spark, sf).count() == now.count()
    assert simhash.keep_one(docs).count() <= docs.count()


def test_pipeline_stages_on_odd_tables(spark, sf, tmp_path):
    """Nulls, repeated rows, empty and long texts, and columns named like what the operators make."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    own = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(None, None, None, None, None), (None, "", "en", "a", 0), (7, "", None, None, None), (7, "a b " * 30_000, "en", "a", 120_000), (7, "a b " * 30_000, "en", "a", 120_000)]
    from pyspark.sql import functions as F

    odd = own.unionByName(spark.createDataFrame(rows, own.schema))
    for c in ("id", "th", "marks", "root", "score", "in_score", "spans", "fingerprint", "text_hash", "__key", "__text", "taken", "size", "key", "part", "n_words", "c0", "k0", "d1"):
        odd = odd.withColumn(c, F.lit(c))
    now, left = odd, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
        now = written(stage(spark, now, str(tmp_path)), "odd")
        if k < 4:
            assert now.columns == odd.columns
            assert now.where("root <> 'root' or score <> 'score' or size <> 'size' or k0 <> 'k0'").isEmpty()
        left.append(now.count())
    assert left[4] > 0 and left == sorted(left, reverse=True)
