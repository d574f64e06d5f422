"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from labelled documents: words and word beginnings that
stand in toxic documents far more often than chance mark the tokens of toxic
documents. The field has two tags; a token's emission is a bias plus the weights
of its markers, and a whole text is one chain.
Forward-backward marginals say how likely each token is toxic; they aggregate to
a document's score through a logistic regression, and runs of tokens that are
likelier toxic than not are the offending spans.

Many chains are computed at once: texts are cut into blocks of STEP tokens, each
block's transfer matrix is built, messages go from block to block through these,
and each block is then finished with the messages from both sides. In a text
without markers a token's marginal follows from its distances to both ends alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import textbytes as tb
from sightline.llm.frames import table, with_text
from sightline.llm.sample import fold, labelled

#: The sample that the model is fitted on: rows of each label and bytes of text.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 1500, 4500, 8 << 20
PREFIXES = (4, 5, 6, 7, 8)
STEP = 32
ROUNDS = 80
LEAST_GAIN = 10.0
BLOCK_BYTES = 2 << 20
MADE = ("score", "predicted", "spans")


def tokens(texts: pa.Array) -> tb.Words:
    """Words of letters and digits, A-Z and the capital letters of Latin-1 lower-cased."""
    w = tb.Words(texts, tb.ALNUM, True)
    buf = w.buf.copy()
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    up = after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
    buf[up] += 0x20
    w.buf = buf
    return w


def marks(w: tb.Words) -> np.ndarray:
    """A token's features: its hash and those of its beginnings, zero for none; one column each."""
    out = np.zeros((len(w), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = w.hashes()
    size = w.ends - w.starts
    for j, k in enumerate(PREFIXES, 1):
        i = np.flatnonzero(size > k)
        out[i, j] = tb.mix(w.range_hashes(w.starts[i], w.starts[i] + k) + np.uint64(k))
    return out


class Blocks:
    """The blocks of at most `step` tokens of texts with so many tokens."""

    def __init__(self, counts: np.ndarray, step: int = STEP):
        n = -(-counts // step)
        doc = np.repeat(np.arange(len(counts)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        self.first = (np.cumsum(counts) - counts)[doc] + k * step
        self.size = np.minimum(step, counts[doc] - k * step)
        self.head = k == 0
        self.step = step
        order = np.argsort(k, kind="stable")
        #: the second blocks of all texts that have one, the third ones, ...
        self.levels = np.split(order, np.searchsorted(k[order], np.arange(1, int(n.max(initial=0)))))[1:]

    def place(self, token: np.ndarray) -> np.ndarray:
        """Where tokens stand in a (blocks, step) table."""
        block = np.searchsorted(self.first, token, "right") - 1
        return block * self.step + token - self.first[block]

    def inside(self) -> np.ndarray:
        return np.arange(self.step)[None] < self.size[:, None]


def forward_backward(e: np.ndarray, blocks: Blocks, t: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 (blocks, step), and the expected tag pairs of all chains; e: emissions of tag 1.

    Messages are kept as the ratio of tag 1 to tag 0.
    """
    m00, m01, m10, m11 = np.exp(t).ravel()
    pot = np.ascontiguousarray(np.exp(np.clip(e, -30, 30)).T)
    step, n = pot.shape
    head, begin, r_in, s_out = blocks.head, np.exp(start), np.zeros(n), np.ones(n)
    if blocks.levels:
        f00, f01 = np.where(head, 1.0, m00), np.where(head, begin, m01) * pot[0]
        f10, f11 = np.where(head, 1.0, m10), np.where(head, begin, m11) * pot[0]
        for j in range(1, step):
            q00, q01 = f00 * m00 + f01 * m10, (f00 * m01 + f01 * m11) * pot[j]
            q10, q11 = f10 * m00 + f11 * m10, (f10 * m01 + f11 * m11) * pot[j]
            c = 1 / (q00 + q01 + q10 + q11)
            live = blocks.size > j
            f00, f01, f10, f11 = (np.where(live, q * c, f) for q, f in ((q00, f00), (q01, f01), (q10, f10), (q11, f11)))
        for i in blocks.levels:
            p = i - 1
            r_in[i] = (f01[p] + r_in[p] * f11[p]) / (f00[p] + r_in[p] * f10[p])
        for i in reversed(blocks.levels):
            s_out[i - 1] = (f10[i] + f11[i] * s_out[i]) / (f00[i] + f01[i] * s_out[i])
    r = np.empty((step, n))
    r[0] = np.where(head, begin, (m01 + r_in * m11) / (m00 + r_in * m10)) * pot[0]
    for j in range(1, step):
        r[j] = pot[j] * (m01 + r[j - 1] * m11) / (m00 + r[j - 1] * m10)
    p, pairs, s = np.empty((step, n)), np.zeros((2, 2)), s_out
    for j in range(step - 1, -1, -1):
        odds = r[j] * s
        p[j] = odds / (1 + odds)
        inside = blocks.size > j
        ahead = pot[j] * s
        pairs += _pairs(r[j - 1] if j else r_in, ahead, (m00, m01, m10, m11), inside if j else inside & ~head)
        s = np.where(inside, (m10 + m11 * ahead) / (m00 + m01 * ahead), s)
    return p.T, pairs


def _pairs(before: np.ndarray, ahead: np.ndarray, m: tuple, weight: np.ndarray) -> np.ndarray:
    """Expected tag pairs of neighbours: the ratio up to the first, potential and ratio from the second on."""
    w = np.stack([np.full(len(before), m[0]), m[1] * ahead, m[2] * before, m[3] * before * ahead])
    return (w @ (weight / w.sum(0))).reshape(2, 2)


def plain_ratios(pot: float, t: np.ndarray, start: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of chains in which every token has one potential: the ratio at each distance from the start, and from the end."""
    m00, m01, m10, m11 = np.exp(t).ravel().tolist()
    ahead, back = np.empty(n), np.empty(n)
    for out, x, step in ((ahead, float(np.exp(start)) * pot, lambda r: pot * (m01 + r * m11) / (m00 + r * m10)), (back, 1.0, lambda s: (m10 + m11 * pot * s) / (m00 + m01 * pot * s))):
        for k in range(n):
            out[k] = x
            after = step(x)
            if after == x:  # from here on nothing changes
                out[k:] = x
                break
            x = after
    return ahead, back


class Field:
    """Markers with weights, a bias, transitions and the documents' regression."""

    def __init__(self, texts: list[str], y: np.ndarray, prior: float):
        t = pa.array(texts)
        parts = [(a, b) for a, b in tb.blocks(t, BLOCK_BYTES)]
        # of texts that share their least sequences of words one is enough
        seen: set[int] = set()
        use = np.zeros(len(texts), bool)
        for a, b in parts:
            w = tokens(t.slice(a, b - a))
            g = tb.sequence_hashes(w.hashes(), 6)
            for d in range(b - a):
                part = g[w.word_off[d] : max(w.word_off[d] + 1, w.word_off[d + 1] - 5)]
                least = np.partition(part, min(1, len(part) - 1))[:2].tolist() if len(part) else [a + d]
                use[a + d] = not seen.intersection(least)
                seen.update(least)
        toxic = use & (y == 1)
        n_toxic, n_clean = int(toxic.sum()), int((use & (y == 0)).sum())

        def features(which: np.ndarray) -> Iterator[np.ndarray]:
            for a, b in parts:
                w = tokens(t.slice(a, b - a))
                f = marks(w)
                doc = w.doc_of()
                f, d = f[which[a:b][doc]], doc[which[a:b][doc]]
                key = f.ravel()
                of = np.repeat(d, f.shape[1])[key > 0]
                key = key[key > 0]
                o = np.lexsort((key, of))
                key, of = key[o], of[o]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                yield key[first]

        have, n1 = np.unique(np.concatenate([*features(toxic), np.zeros(0, np.uint64)]), return_counts=True)
        have, n1 = have[n1 >= 3], n1[n1 >= 3]
        n0 = np.zeros(len(have), np.int64)
        for f in features(use & (y == 0)):
            i = np.searchsorted(have, f)
            i = i[(i < len(have)) & (have[np.minimum(i, len(have) - 1)] == f)] if len(have) else i[:0]
            np.add.at(n0, i, 1)
        p = n_toxic / max(1, n_toxic + n_clean)
        m = n1 + n0
        gain = n1 * np.log(n1 / (m * p)) + n0 * np.log(np.maximum(n0, 1e-9) / (m * (1 - p)))
        good = (gain >= LEAST_GAIN) & (n1 > 2 * m * p)
        self.markers = have[good]
        self._fit(t, parts, y)
        x = np.concatenate([self.document_features(tokens(t.slice(a, b - a)))[0] for a, b in parts])
        self._regress(x, y, prior)

    def active(self, w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and markers, a pair for each marker of a token."""
        if not len(self.markers) or not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        f = marks(w)
        low = np.zeros(1 << 16, bool)
        low[self.markers & np.uint64(0xFFFF)] = True
        row, col = np.nonzero(low[f & np.uint64(0xFFFF)])
        key = f[row, col]
        i = np.minimum(np.searchsorted(self.markers, key), len(self.markers) - 1)
        ok = self.markers[i] == key
        return row[ok], i[ok]

    def _fit(self, t: pa.Array, parts: list, y: np.ndarray) -> None:
        rows, cols, labels, counts, plain, base = [], [], [], [], [], 0
        for a, b in parts:
            w = tokens(t.slice(a, b - a))
            row, col = self.active(w)
            n, doc = w.counts(), w.doc_of()
            marked, new = np.unique(doc[row], return_inverse=True)
            off = np.cumsum(n[marked]) - n[marked]
            at = base + off[new] + row - w.word_off[doc[row]]
            rows.append(at)
            cols.append(col)
            labels.append(at[y[a:b][doc[row]] == 1])
            counts.append(n[marked])
            plain.append(np.delete(n, marked))
            base += int(n[marked].sum())
        col, blocks = np.concatenate(cols), Blocks(np.concatenate(counts))
        size = len(blocks.first) * STEP
        row = blocks.place(np.concatenate(rows)) if size else np.zeros(0, np.int64)
        tag = np.zeros(size, np.int8)
        tag[blocks.place(np.concatenate(labels)) if size else row] = 1
        want = np.bincount(col, tag[row], len(self.markers))
        inside = blocks.inside().ravel()
        follow = inside.copy()
        follow[np.flatnonzero(blocks.head) * STEP] = False
        # a block is full wherever another of its text follows, so the token before stands one place before
        before, here = tag[np.flatnonzero(follow) - 1], tag[follow]
        seen = np.bincount(2 * before + here, minlength=4).reshape(2, 2).astype(float)
        heads = np.flatnonzero(blocks.head) * STEP
        # texts without markers differ in length only: one of each length, with its number as weight
        length, often = np.unique(np.concatenate(plain), return_counts=True)
        length, often = length[length > 0], often[length > 0]
        seen[0, 0] += ((length - 1) * often).sum()
        k = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        rest_of, weight = np.repeat(length, length) - 1 - k, np.repeat(often, length).astype(float)
        self.w, self.bias, self.t, self.start = np.zeros(len(self.markers)), -3.0, np.zeros((2, 2)), 0.0
        size_w, size_r = np.full(len(self.markers), 1e-6), np.full(6, 1e-6)
        for _ in range(ROUNDS):  # adaptive gradient ascent of the conditional log-likelihood
            e = (np.bincount(row, self.w[col], size) + self.bias).reshape(-1, STEP)
            p, pairs = forward_backward(e, blocks, self.t, self.start) if size else (e, np.zeros((2, 2)))
            p = np.where(inside, p.ravel(), 0.0)
            total, first = p.sum(), p[heads].sum()
            if len(length):
                pot = float(np.exp(self.bias))
                ahead, back = plain_ratios(pot, self.t, self.start, int(length[-1]))
                odds = ahead[k] * back[rest_of]
                q = odds / (1 + odds) * weight
                total, first = total + q.sum(), first + q[k == 0].sum()
                i = np.flatnonzero(k)
                pairs = pairs + _pairs(ahead[k[i] - 1], pot * back[rest_of[i]], tuple(np.exp(self.t).ravel()), weight[i])
            g = want - np.bincount(col, p[row], len(self.markers)) - 0.1 * self.w
            rest = np.concatenate([[tag.sum() - total, tag[heads].sum() - first], (seen - pairs).ravel()]) - 0.01 * np.concatenate([[self.bias, self.start], self.t.ravel()])
            size_w += g * g
            size_r += rest * rest
            self.w += 0.6 * g / np.sqrt(size_w)
            step = 0.3 * rest / np.sqrt(size_r)
            self.bias += step[0]
            self.start += step[1]
            self.t += step[2:].reshape(2, 2)
        self._plain = plain_ratios(float(np.exp(self.bias)), self.t, self.start, 1 << 12)

    def marginals(self, w: tb.Words) -> np.ndarray:
        """How likely each token is toxic, in its whole text."""
        counts, doc = w.counts(), w.doc_of()
        if not len(doc):
            return np.zeros(0)
        if len(self._plain[0]) < counts.max():
            self._plain = plain_ratios(float(np.exp(self.bias)), self.t, self.start, int(counts.max()))
        k = np.arange(len(w)) - w.word_off[doc]
        odds = self._plain[0][k] * self._plain[1][counts[doc] - 1 - k]
        out = odds / (1 + odds)
        row, col = self.active(w)
        marked, new = np.unique(doc[row], return_inverse=True)
        if len(marked):
            n = counts[marked]
            blocks = Blocks(n)
            at = blocks.place((np.cumsum(n) - n)[new] + row - w.word_off[doc[row]])
            e = (np.bincount(at, self.w[col], len(blocks.first) * STEP) + self.bias).reshape(-1, STEP)
            p, _ = forward_backward(e, blocks, self.t, self.start)
            mine = np.zeros(len(counts), bool)
            mine[marked] = True
            out[mine[doc]] = p[blocks.inside()]
        return out

    def document_features(self, w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        p = self.marginals(w)
        n = len(w.word_off) - 1
        counts = w.counts()
        doc = w.doc_of()
        sums = np.bincount(doc, p, n)
        top = np.zeros(n)
        np.maximum.at(top, doc, p)
        none = np.bincount(doc, -np.log1p(-np.minimum(p, 1 - 1e-6)), n)
        many = np.bincount(doc, p > 0.5, n)
        return np.stack([np.minimum(sums, 8), np.log1p(sums), np.minimum(none, 30) / 5, top, np.minimum(many, 1), np.minimum(many, 2), np.minimum(many, 4), np.log1p(100 * sums / np.maximum(counts, 1)), np.log1p(counts)], 1), p

    def _regress(self, x: np.ndarray, y: np.ndarray, prior: float) -> None:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        f = np.concatenate([(x - self.mean) / self.std, np.ones((len(x), 1))], 1)
        # each label weighs as much as it does among all labelled rows
        share = y.mean()
        weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
        b = np.zeros(f.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(f @ b, -30, 30)))
            grad = f.T @ (weight * (p - y)) + 0.5 * b
            hess = (f * (weight * p * (1 - p))[:, None]).T @ f + 0.5 * np.eye(len(b))
            step = np.linalg.solve(hess, grad)
            b -= step
            if np.abs(step).max() < 1e-8:
                break
        self.b = b

    def score(self, w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts, and the marginals of their tokens."""
        x, p = self.document_features(w)
        z = ((x - self.mean) / self.std) @ self.b[:-1] + self.b[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), p


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """A field from the labelled documents outside the held-out fold; None if one of the labels is missing."""
    allowed = fold(F.col("doc_id"), 5) != 0
    rows = MOST_TOXIC + MOST_CLEAN
    most = {value: (n, MOST_BYTES * n // rows) for value, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))}
    texts, y = labelled(docs, labels, "toxic", allowed, id_col=id_col, text_col=text_col, most=most)
    if len(set(y)) < 2:
        return None
    prior = labels.where(allowed & F.col("toxic").isNotNull()).agg(F.avg("toxic")).first()[0]
    return Field(texts, np.array(y), float(prior))


def score_toxicity(docs: DataFrame, model: Field | None, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns of keep, score (0 to 1), spans, predicted (1 from 0.5 on).

    spans: structs (start, end, p) of runs of toxic tokens, in code points of the
    text, with their highest marginal. A null or empty text has no tokens and gets
    the score of none. Without a model every score is 0. Repeated rows each come out;
    an empty table gives no rows; a kept column with an output's name comes out as
    in_<name>.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    source, at, own = with_text(docs, keep, MADE, text_col)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([source.schema[c] for c in own] + [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        model = held.value
        for batch in batches:
            texts = batch.column(at)
            for a, b in tb.blocks(texts, BLOCK_BYTES):
                part = batch.slice(a, b - a).columns[: len(own)]
                found: list[list] = [[] for _ in range(b - a)]
                score = np.zeros(b - a)
                if model:
                    w = tokens(texts.slice(a, b - a))
                    score, p = model.score(w)
                    hit = p > 0.5
                    doc = w.doc_of()
                    i = np.flatnonzero(hit)
                    if len(i):
                        lead = np.ones(len(i), bool)
                        lead[1:] = (i[1:] != i[:-1] + 1) | (doc[i[1:]] != doc[i[:-1]])
                        s = np.flatnonzero(lead)
                        e = np.append(s[1:], len(i)) - 1
                        point = np.cumsum((w.buf & 0xC0) != 0x80)
                        base = point[w.doc_off[:-1]]
                        d = doc[i[s]]
                        top = np.maximum.reduceat(p[i], s)
                        # a word's last byte may be inside a character: count to the separator behind it
                        for k, x, z, q in zip(d.tolist(), (point[w.starts[i[s]]] - base[d]).tolist(), (point[w.ends[i[e]]] - base[d]).tolist(), top.tolist(), strict=True):
                            found[k].append({"start": x, "end": z, "p": q})
                yield pa.RecordBatch.from_arrays([*part, pa.array(score), pa.array(found, kind)], names=names)

    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "spans")
