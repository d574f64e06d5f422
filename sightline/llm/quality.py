"""A quality classifier by Bradley-Terry pairwise ranking.

Labelled documents form preference pairs, each a good one over a bad one. The
probability that one is preferred is the logistic function of the difference of
two scores, each linear in the document's binned surface features; the weights
minimise that loss over the pairs. The quantile of all labelled documents' scores at
their share of bad ones is the threshold, and the score put out is the logistic function
of the distance to it, shifted so that the threshold stands at 0.7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import textbytes as tb
from sightline.llm.frames import cut, table, with_text
from sightline.llm.sample import fold

#: The sample that the model is fitted on.
MOST_ROWS, PAIRS = 6000, 24_000
PAIRS_AT_ONCE = 2_000
BINS = 8
THRESHOLD = 0.7
SCORE_BINS = 4096
BLOCK_BYTES = 2 << 20
MADE = ("score", "predicted")

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>@^~={}[]\\_+")] = True


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many values it has that stood before, and how often its commonest stands."""
    key = tb.mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(k)))
    d = doc[order[at]]
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, d, many)
    return np.bincount(doc, minlength=n_docs) - np.bincount(d, minlength=n_docs), top


def features(texts: pa.Array) -> np.ndarray:
    """Surface features of each text, from its bytes alone."""
    w = tb.Words(texts, tb.NOT_SPACE, False)
    n = len(w.word_off) - 1
    if not n:
        return np.zeros((0, 16))
    raw, off = w.buf, w.doc_off
    size = np.diff(off) - 1
    words = w.counts()
    count = lambda mask: tb.segment_sums(mask, off)
    letters = count(_LETTER[raw])
    h, doc = w.hashes(), w.doc_of()
    length = w.ends - w.starts
    again, top = _repeats(doc, h, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pairs = tb.sequence_hashes(h, 2)
    inside = doc[1:] == doc[:-1] if len(h) > 1 else np.zeros(0, bool)
    pair_again, _ = _repeats(doc[:-1][inside], pairs[inside], n) if len(pairs) else (np.zeros(n, np.int64), None)
    # lines: from each text's start or newline to the next
    newline = raw == 0x0A
    line = np.cumsum(newline) - newline + np.repeat(np.arange(n), np.diff(off))
    word_line = line[w.starts]
    first = np.ones(len(h), bool)
    first[1:] = word_line[1:] != word_line[:-1]
    at = np.flatnonzero(first)
    line_hash = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(h)))).astype(np.uint64) + np.uint64(1)), at) if len(at) else np.zeros(0, np.uint64)
    line_again, _ = _repeats(doc[at], line_hash, n)
    lines = np.bincount(doc[at], minlength=n)
    shout = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_UPPER[raw], out=shout[1:])
    loud = (shout[w.ends] - shout[w.starts]) * 2 > length
    mean = _share(np.bincount(doc, length, n), words)
    out = [
        np.log1p(words), mean, np.sqrt(np.maximum(0, _share(np.bincount(doc, length.astype(float) ** 2, n), words) - mean**2)),
        _share(count(_UPPER[raw]), letters), _share(np.bincount(doc, loud, n), words), _share(count(_SYMBOL[raw]), size), _share(count(raw == 0x7C), words), _share(count(raw == 0x21), words),
        _share(count((raw == 0x2E) | (raw == 0x2C)), words), _share(count((raw >= 0x30) & (raw <= 0x39)), size), _share(letters, size), _share(again, words), _share(top, words),
        _share(np.bincount(doc, same, n), words), _share(pair_again, words), _share(line_again, lines),
    ]
    return np.stack(out, 1)


class Ranking:
    """Bin borders, a weight for each bin, and the threshold, which fit() sets."""

    threshold = 0.0

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = BINS, pairs: int = PAIRS):
        self.borders = [np.unique(np.quantile(np.concatenate([x[y == 0][:, j], x[y == 1][:, j]]), np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.borders = [np.unique(np.concatenate([b, np.quantile(x[y == 0][:, j], [0.25, 0.5, 0.75])])) for j, b in enumerate(self.borders)]
        f = self.binned(x)
        rng = np.random.default_rng(11)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        d = f[rng.choice(good, pairs)] - f[rng.choice(bad, pairs)]
        w = np.zeros(f.shape[1])
        for _ in range(25):  # Newton steps on the mean logistic loss with a ridge
            grad, hess = 1e-3 * w, 1e-3 * np.eye(len(w))
            for at in range(0, pairs, PAIRS_AT_ONCE):
                e = d[at : at + PAIRS_AT_ONCE].astype(float)
                p = 1 / (1 + np.exp(-np.clip(e @ w, -30, 30)))
                grad -= e.T @ (1 - p) / pairs
                hess += (e * (p * (1 - p))[:, None]).T @ e / pairs
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def bins(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each feature, the place of each row's bin among all weights."""
        at = 0
        for j, b in enumerate(self.borders):
            yield at + np.searchsorted(b, x[:, j], "right")
            at += len(b) + 1

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), sum(len(b) + 1 for b in self.borders)), np.int8)
        for at in self.bins(x):
            out[np.arange(len(x)), at] = 1
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Each row's weights summed in one order, so that a row's score doesn't hang on those beside it."""
        out = np.zeros(len(x))
        for at in self.bins(x):
            out += self.w[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.threshold + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_features(docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, o, f): features and label of every labelled document that allowed, a condition on doc_id, holds for; o is a hash of the id.

    Features are made where the texts are, so that no text is shuffled or collected.
    Null ids, labels and texts are left out; of rows with one id the least features serve.
    """
    base = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & allowed).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("id").isNotNull() & F.col("t").isNotNull())
    schema = T.StructType([source.schema["id"], T.StructField("f", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in tb.blocks(texts, BLOCK_BYTES):
                x = features(texts.slice(a, b - a))
                off = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))], names=["id", "f"])

    found = source.mapInArrow(run, schema).join(base.hint("merge"), "id").groupBy("id", "y").agg(F.min("f").alias("f"))
    return found.select("id", "y", F.xxhash64("id").alias("o"), "f")


def quantile_at(scores: DataFrame, k: int) -> float:
    """The middle between the k-th and the next of all values of s in order; only the bins that hold them come to the driver."""
    lo, hi = scores.agg(F.min("s"), F.max("s")).first()
    if lo == hi:
        return lo
    binned = scores.withColumn("b", F.floor((F.col("s") - lo) / (hi - lo) * SCORE_BINS))
    below, bins, before = 0, [], 0
    for r in binned.groupBy("b").count().orderBy("b").collect():
        if below < k + 1 and below + r["count"] >= k:
            before = before if bins else below
            bins.append(r.b)
        below += r["count"]
    near, at = [], before
    for r in binned.where(F.col("b").isin(bins)).groupBy("s").count().orderBy("s").collect():
        near += [r.s for rank in (k, k + 1) if at < rank <= at + r["count"]]
        at += r["count"]
    return sum(near) / 2


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> Ranking | None:
    """A ranking from the labelled documents outside the held-out fold; None if one of the labels is missing.

    The weights are fitted on the first most_rows by a hash of the id, whatever the
    texts' lengths; the threshold is taken from all.
    """
    rows = cut(labelled_features(docs, labels, fold(F.col("doc_id"), 4) != 2, id_col=id_col, text_col=text_col))
    sample = rows.orderBy("o", "id").limit(most_rows).select("y", "f").toArrow()
    y = sample["y"].to_numpy()
    if len(set(y)) < 2:
        return None
    model = Ranking(np.array(sample["f"].combine_chunks().flatten()).reshape(len(y), -1), y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)))], names=["s"])

    n, bad = rows.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 0)).first()
    model.threshold = quantile_at(rows.select("f").mapInArrow(run, "s double"), min(max(bad, 1), n - 1))
    return model


def score_quality(docs: DataFrame, model: Ranking | None, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns of keep, score (0 to 1), predicted (1 from 0.7 on).

    A null or empty text is scored from its zero counts. Without a model every score
    is 0.7. Repeated rows each come out; an empty table gives no rows; a kept column
    with an output's name comes out as in_<name>.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    source, at, own = with_text(docs, keep, MADE, text_col)
    schema = T.StructType([source.schema[c] for c in own] + [T.StructField("score", T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            parts = [held.value.score(features(texts.slice(a, b - a))) if held.value else np.full(b - a, THRESHOLD) for a, b in tb.blocks(texts, BLOCK_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=names)

    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
