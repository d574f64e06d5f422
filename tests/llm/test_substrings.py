import re
from collections import Counter

import numpy as np
import pytest

from sightline.llm import substrings as S


def brute(texts, window):
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    word = lambda n, v: " ".join(rng.choice([f"w{i}" for i in range(v)], n))
    passages = [word(int(n), 500) for n in (34, 35, 36, 60, 120)]
    texts = []
    for i in range(40):
        parts = [word(int(rng.integers(0, 50)), 500)]
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, 5))].split(" ")
            a = int(rng.integers(0, 20))
            parts += [" ".join(p[a:]), word(int(rng.integers(0, 9)), 500)]
        texts.append("  ".join(parts))
    texts += [None, "", " \t", "As " * 300, "As " * 40, "x " + "As " * 36, "a b " * 60, texts[0], texts[0], word(34, 9), "é " * 20_000]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = S.remove_repeated(docs, keep=["doc_id", "text"]).collect()
    want = brute(texts, 35)
    assert sorted([(r.text or "", r.n_words, r.n_removed, r.kept_text) for r in got]) == sorted([(t or "", *w) for t, w in zip(texts, want, strict=True)])


def test_small_windows_and_names(spark):
    texts = ["a b c d e", "x b c d y", "b c d", "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'mine' as n_words")
    got = S.remove_repeated(docs, keep=["doc_id", "n_words"], window=3, gram=2).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text, r.in_n_words) for r in got) == [(i, *w[1:], "mine") for i, w in enumerate(brute(texts, 3))]
    assert S.remove_repeated(docs.limit(0)).count() == 0


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BITS", 8)
    monkeypatch.setattr(S, "MOST_BITS", 8)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"], 200)) for _ in range(30)]
    texts += [" ".join(t.split(" ")[20:120]) for t in texts[:9]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in S.remove_repeated(docs).collect())
    assert got == [(i, *w) for i, w in enumerate(brute(texts, 35))]


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "x " + text), (3, "y")], "doc_id long, text string")
    for c in ("id", "th", "marks", "own_id", "own_th", "c0", "n_words", "m_first"):
        df = df.withColumn(c, F.lit(c))
    for keep in (df.columns, [c for c in df.columns if c != "text"]):
        got = {r.doc_id: r for r in S.remove_repeated(df, keep=keep).collect()}
        assert [got[i].n_removed for i in (1, 2, 3)] == [60, 60, 0]
        assert all(r.id == "id" and r.marks == "marks" and r.in_n_words == "n_words" for r in got.values())
