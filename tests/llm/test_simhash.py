import re
from itertools import combinations

import numpy as np
import xxhash

from sightline.llm import graph, simhash
from sightline.operators import graph as graph_ops


def brute(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    prints = set(base.tolist())
    for x in base[:20].tolist():
        for _ in range(6):
            y = x
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                y ^= 1 << int(b)
            prints.add(y - (1 << 64) if y >= 1 << 63 else y)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    got = {tuple(sorted(r)) for r in simhash.links(df).collect()}
    want = {tuple(sorted((a, b))) for a, b in combinations(prints, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want and want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (7, 3), (3, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    text = " ".join(rng.choice([f"w{i}" for i in range(900)], 3000))
    docs = [(9, text), (5, text.upper()), (7, text.replace("w17 ", "v17 ", 1)), (1, None), (2, ""), (3, " \n"), (4, "a"), (8, "a b"), (8, "a b"), (None, "a  b"), (30, "é è ß " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    f = [brute(t) for _, t in docs]
    comp = roots(range(len(docs)), [(i, j) for i, j in combinations(range(len(docs)), 2) if bin(f[i] ^ f[j]).count("1") <= 3])
    least = {k: min([docs[i][0] for i in comp if comp[i] == k and docs[i][0] is not None], default=None) for k in set(comp.values())}
    want = sorted(((docs[i][0] or -1, f[i] - (1 << 64) if f[i] >> 63 else f[i], least[comp[i]]) for i in range(len(docs))), key=str)
    assert got == want
    stay = simhash.keep_one(df).collect()
    assert len(stay) == len(set(comp.values()))
    assert {r.doc_id for r in stay} == set(least.values())
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, fingerprint string")
    r = simhash.near_duplicates(df, keep=["doc_id", "fingerprint", "text"]).first()
    assert r.in_fingerprint == "x" and r.text == "a b c" and r.component_id == 1


def test_crowded_segments_have_the_same_components(spark):
    """Keys with cleared bits in place of pairs join the same fingerprints."""
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    prints = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for j in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(j)
            prints.add(x)
    prints = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in prints)
    df = spark.createDataFrame([(x,) for x in prints], "fingerprint long")
    mask = (1 << 64) - 1
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin((a ^ b) & mask).count("1") <= 3]
    want = roots(prints, near)
    for crowd in (1, 4, 1000):
        got = [(r.u, r.v) for r in simhash.links(df, crowd).collect()]
        assert all(0 < bin((a ^ b) & mask).count("1") <= 3 for a, b in got)
        assert roots(prints, got) == want


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (None, None), (None, "")], "doc_id long, text string")
    for c in ("root", "id", "fingerprint", "text_hash", "least", "__key", "k0", "c0"):
        df = df.withColumn(c, F.lit(c))
    got = simhash.near_duplicates(df, keep=df.columns).collect()
    assert len(got) == 4 and all(r.root == "root" and r.in_fingerprint == "fingerprint" and r.id == "id" for r in got)
    one = simhash.keep_one(df)
    assert one.columns == df.columns and sorted((str(r.doc_id), r["__key"]) for r in one.collect()) == [("1", "__key"), ("None", "__key")]


def test_growing_joins_are_merged(spark, monkeypatch, tmp_path):
    """However small Spark believes them, no side that grows with the corpus is broadcast: the driver couldn't hold it."""
    plans = []

    def noted(df, cut=graph_ops.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph_ops, "cut", noted)
    spark.createDataFrame([(i, f"some words of text number {i // 2} and more of them") for i in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))  # with a size that Spark knows
    for out in (simhash.near_duplicates(docs), simhash.links(simhash.with_fingerprint(docs).select("fingerprint").distinct())):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
