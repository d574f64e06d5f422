"""Substring dedup: a count-min prefilter, then exact grouping of what it lets through.

A window is WINDOW consecutive words. Every window is counted under its least
GRAM-word hash (its anchor; equal windows have equal anchors at the same offset),
so consecutive windows that share an anchor make one run and one count.

1. Each task counts its runs' anchors into a count-min sketch of ROWS rows and
   sends it, sparse, to the stripes' owners, which merge it to one bit a cell:
   hit twice or more. An estimate is never below the true count.
2. A second pass over the texts keeps only runs whose anchor is estimated
   repeated and groups those exactly by their whole context: a context found
   twice makes all its windows repeated.
3. Where contexts of an anchor differ and one stands alone, a third pass brings
   these contexts' windows, which are grouped one by one over distinct contexts.
4. The repeated windows' places go back to their texts.

The merged sketch is broadcast. Its size follows the corpus up to 2**MOST_BITS
cells a row (64 MB a row); beyond, more unrepeated runs pass the filter, which
costs time in step 2 and changes no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import textbytes as tb
from sightline.llm.frames import table, with_text, written

WINDOW = 35
GRAM = 8
ROWS = 2
LEAST_BITS, MOST_BITS = 16, 29
STRIPE_BITS = 16
BLOCK_BYTES = 2 << 20
FLUSH_RUNS = 4 << 20
MADE = ("n_words", "n_removed", "kept_text")


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    level, span = x, 1
    while span * 2 <= width:
        level = np.minimum(level[:-span], level[span:])
        span *= 2
    rest = width - span
    return np.minimum(level[: len(level) - rest], level[rest:]) if rest else level


class Runs:
    """The runs of consecutive windows that share an anchor, in the texts of w."""

    def __init__(self, w: tb.Words, window: int, gram: int):
        h = w.hashes()
        n = len(h)
        width = window - gram + 1
        self.gram = np.zeros(0, np.uint64)
        self.first = self.doc = self.size = self.offset = np.zeros(0, np.int64)
        self.windows = np.zeros(0, np.uint64)
        counts = np.maximum(w.counts() - window + 1, 0)
        if not counts.sum():
            return
        g = tb.sequence_hashes(h, gram)
        low = np.uint64((1 << 24) - 1)
        step = (1 << 24) - width  # so that a place fits beside the hash, however long a text is
        leasts = []
        for a in range(0, n - window + 1, step):
            part = g[a : a + step + width - 1]
            leasts.append((_sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), width) & low).astype(np.int64) + a)
        least = np.concatenate(leasts)
        doc = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts - w.word_off[:-1], counts)
        anchor = least[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.first, self.doc = start[at], doc[at]
        self.size = np.diff(np.append(at, len(start)))
        self.offset = anchor[at] - self.first
        self.gram = g[anchor[at]]
        self.h = h
        self.window = window

    def window_hashes(self) -> np.ndarray:
        return tb.sequence_hashes(self.h, self.window)


def _cells(gram: np.ndarray, row: int, bits: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (2 * row + 1)) & ((1 << 64) - 1))
    return tb.mix((gram ^ salt) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - bits)


def _pack(cells: np.ndarray) -> bytes:
    """Ascending 32-bit numbers, as differences in byte planes."""
    d = np.diff(cells, prepend=0).astype("<u4")
    return zlib.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u4").ravel(), dtype=np.int64)


def _stripes(bits: int) -> tuple[int, int]:
    """Bits within a stripe, stripes a row."""
    stripe_bits = min(max(STRIPE_BITS, bits - 5), bits)
    return stripe_bits, 1 << (bits - stripe_bits)


def _sparse(grams: np.ndarray, bits: int, all_twice: bool) -> Iterator[pa.RecordBatch]:
    """The sketch of some anchors, a row for each stripe they touch: ascending cells, each with a bit for twice."""
    stripe_bits, per_row = _stripes(bits)
    for row in range(ROWS):
        cell = np.sort(_cells(grams, row, bits))
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        at = np.flatnonzero(first)
        twice = (np.diff(np.append(at, len(cell))) > 1) | all_twice
        cell = cell[at].astype(np.int64)
        cut = np.searchsorted(cell >> stripe_bits, np.arange(per_row + 1))
        stripes = [s for s in range(per_row) if cut[s] < cut[s + 1]]
        blobs = [_pack(((cell[cut[s] : cut[s + 1]] & ((1 << stripe_bits) - 1)) << 1) | twice[cut[s] : cut[s + 1]]) for s in stripes]
        if stripes:
            yield pa.RecordBatch.from_arrays([pa.array([row * per_row + s for s in stripes], pa.int32()), pa.array(blobs, pa.binary())], names=["stripe", "cells"])


def _merged(parts: DataFrame, bits: int) -> np.ndarray:
    """ROWS x 2**bits bits, packed: the cells that all the sketches together hit twice or more."""
    stripe_bits, _ = _stripes(bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s not in once:
                    once[s], twice[s] = np.zeros(1 << stripe_bits, bool), np.zeros(1 << stripe_bits, bool)
                x = _unpack(blob)
                cell = x >> 1
                twice[s][cell[once[s][cell] | (x & 1).astype(bool)]] = True
                once[s][cell] = True
        for s, bitmap in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bitmap, bitorder="little").tobytes()], pa.binary())], names=["stripe", "bits"])

    merged = parts.repartition(F.col("stripe")).mapInArrow(merge, "stripe int, bits binary")
    out = np.zeros(ROWS << (bits - 3), np.uint8)
    step = 1 << (stripe_bits - 3)
    for r in merged.toLocalIterator():
        out[r.stripe * step : (r.stripe + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return out


def _holds(sketch: np.ndarray, bits: int, gram: np.ndarray) -> np.ndarray:
    maybe = np.ones(len(gram), bool)
    for row in range(ROWS):
        cell = _cells(gram, row, bits).astype(np.int64) + (row << bits)
        maybe &= (sketch[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
    return maybe


def corpus_sketch(docs: DataFrame, text_col: str, bits: int, window: int, gram: int) -> np.ndarray:
    """The merged sketch of all runs' anchors."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for a, b in tb.blocks(batch.column(0), BLOCK_BYTES):
                r = Runs(tb.Words(batch.column(0).slice(a, b - a), tb.NOT_SPACE, False), window, gram)
                grams.append(r.gram)
                size += len(r.gram)
                if size >= FLUSH_RUNS:
                    yield from _sparse(np.concatenate(grams), bits, False)
                    grams, size = [], 0
        if size:
            yield from _sparse(np.concatenate(grams), bits, False)

    return _merged(docs.select(F.col(text_col).alias("t")).mapInArrow(local, "stripe int, cells binary"), bits)


def set_sketch(anchors: DataFrame, bits: int) -> np.ndarray:
    """A sketch that holds every anchor of the column g."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sparse(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits, True)

    return _merged(anchors.select("g").mapInArrow(local, "stripe int, cells binary"), bits)


def _context(r: Runs, hs: np.ndarray, i: np.ndarray) -> np.ndarray:
    """A hash of all the words of runs i: their first and last windows overlap."""
    first, n = r.first[i], r.size[i]
    return tb.mix(hs[first] * np.uint64(0xA24BAED4963EE407) + hs[first + n - 1] * np.uint64(0x9FB21C651E98DF25) + (n * 64 + r.offset[i]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _estimated(docs: DataFrame, id_col: str, text_col: str, bits: int, sketch: np.ndarray, window: int, gram: int) -> DataFrame:
    """The runs whose anchor is estimated repeated, one row each."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("t"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("th", "g", "c")] + [T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("times", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for a, b in tb.blocks(texts, BLOCK_BYTES):
                w = tb.Words(texts.slice(a, b - a), tb.NOT_SPACE, False)
                r = Runs(w, window, gram)
                i = np.flatnonzero(_holds(held.value, bits, r.gram))
                if not len(i):
                    continue
                c = _context(r, r.window_hashes(), i)
                # a word said over and over makes run after run of one context: one row for all
                new = np.ones(len(i), bool)
                new[1:] = (c[1:] != c[:-1]) | (r.gram[i[1:]] != r.gram[i[:-1]]) | (r.first[i[1:]] != r.first[i[:-1]] + r.size[i[:-1]]) | (r.doc[i[1:]] != r.doc[i[:-1]])
                lead = np.flatnonzero(new)
                times = np.diff(np.append(lead, len(i)))
                i, c = i[lead], c[lead]
                row = pa.array(r.doc[i] + a)
                made = [pa.array(r.gram[i].view(np.int64)), pa.array(c.view(np.int64)), pa.array((r.first[i] - w.word_off[r.doc[i]]).astype(np.int32)), pa.array(r.size[i].astype(np.int32)), pa.array(times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *made], names=schema.names)

    return source.mapInArrow(run, schema)


def _contexts(docs: DataFrame, text_col: str, bits: int, sketch: np.ndarray, window: int, gram: int) -> DataFrame:
    """(g, c, hs): of the runs whose anchor the sketch holds, the windows' hashes; a context comes once a block at most."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tb.blocks(batch.column(0), BLOCK_BYTES):
                r = Runs(tb.Words(batch.column(0).slice(a, b - a), tb.NOT_SPACE, False), window, gram)
                i = np.flatnonzero(_holds(held.value, bits, r.gram))
                if not len(i):
                    continue
                hs = r.window_hashes()
                c = _context(r, hs, i)
                _, one = np.unique(c ^ r.gram[i], return_index=True)
                i, c = i[one], c[one]
                n = r.size[i]
                flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - r.first[i], n)
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(r.gram[i].view(np.int64)), pa.array(c.view(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(hs[flat].view(np.int64)))], names=["g", "c", "hs"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "g long, c long, hs array<long>")


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, th, marks): for each text with repeated windows, structs (first, n, mask).

    Bit j of mask says that the window at word first + j is repeated; -1: that all
    n windows from first on are.
    """
    if not 1 <= gram <= window or window - gram + 1 > 62:
        raise ValueError("gram must be in 1..window and window - gram at most 61")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bits = min(max(int(3 * size / 70).bit_length(), LEAST_BITS), MOST_BITS)
    sketch = corpus_sketch(docs, text_col, bits, window, gram)
    runs = written(_estimated(docs, id_col, text_col, bits, sketch, window, gram), "runs")
    contexts = runs.groupBy("g", "c").agg(F.sum("times").alias("n_c"))
    mixed = contexts.groupBy("g").agg(F.count(F.lit(1)).alias("n_ctx"), F.min("n_c").alias("fewest")).where("n_ctx > 1 and fewest = 1").select("g")
    # a third pass: the windows of the contexts of anchors that have several
    several = _contexts(docs, text_col, bits, set_sketch(mixed, bits), window, gram)
    distinct = several.groupBy("g", "c").agg(F.any_value("hs").alias("hs")).join(contexts.hint("merge"), ["g", "c"])
    each = distinct.select("g", "c", "n_c", F.posexplode("hs").alias("j", "h"))
    often = each.groupBy("g", "h").agg(F.sum("n_c").alias("n")).where("n > 1").select("g", "h")
    masks = each.where("n_c = 1").join(often.hint("merge"), ["g", "h"]).groupBy("g", "c").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    whole = contexts.where("n_c > 1").select("g", "c", F.lit(-1).cast("long").alias("mask"))
    decided = runs.join(whole.unionByName(masks).hint("merge"), ["g", "c"])
    return decided.groupBy("id", "th").agg(F.collect_set(F.struct("first", (F.col("n") * F.col("times")).alias("n"), "mask")).alias("marks"))


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ("doc_id",), window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: the columns of keep, n_words, n_removed, kept_text.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Each word that a repeated window covers
    goes; windows are judged on the input. kept_text: the other words joined by one
    space, empty where none is left. A null or empty text has no words; one of fewer
    than `window` words has no window; repeated rows make each other's windows
    repeated; an empty table gives no rows; a kept column with an output's name
    comes out as in_<name>.
    """
    marks = repeated_windows(docs, id_col=id_col, text_col=text_col, window=window, gram=gram)
    sent, at_text, outer = with_text(docs, keep, MADE, text_col)
    carried = [f"c{i}" for i in range(len(outer))]
    texts = [] if text_col in keep else ["text"]
    id_key = docs.select(F.col(f"`{id_col}`").alias("own_id"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, carried, strict=True)], *[F.col(f"`{text_col}`").alias(n) for n in texts])
    own = id_key.withColumn("own_th", F.xxhash64(F.coalesce(F.col((carried + texts)[at_text]), F.lit(""))))
    both = own.join(marks.hint("merge"), own["own_id"].eqNullSafe(marks["id"]) & (own["own_th"] == marks["th"]), "left")
    at_marks = len(carried) + len(texts)
    source = both.select(*carried, *texts, *[F.col(f"marks.{f}").alias(f"m_{f}") for f in ("first", "mask", "n")])
    schema = T.StructType([T.StructField(n, sent.schema[o].dataType) for n, o in zip(carried, outer, strict=True)] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tb.blocks(batch.column(at_text), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                w = tb.Words(part.column(at_text), tb.NOT_SPACE, False)
                firsts, masks = part.column(at_marks), part.column(at_marks + 1)
                per = np.diff(np.append(0, np.cumsum([len(x) if x is not None else 0 for x in firsts.to_pylist()]))) if firsts.null_count < len(firsts) else np.zeros(len(firsts), np.int64)
                first = firsts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                mask = masks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                base = np.repeat(w.word_off[:-1], per) + first
                n = part.column(at_marks + 2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                cover = np.zeros(len(w) + 1, np.int64)
                every = mask == -1
                np.add.at(cover, base[every], 1)
                np.add.at(cover, base[every] + n[every] - 1 + window, -1)
                base, mask = base[~every], mask[~every]
                for j in range(window - gram + 1):
                    at = base[(mask >> j) & 1 > 0] + j
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                n_gone = tb.segment_sums(gone, w.word_off)
                buf, at, size = w.joined()
                stay = np.repeat(~gone, size + 1)
                out = buf[:-8][stay]
                left = tb.segment_sums(np.where(gone, 0, size + 1), w.word_off)
                ends = np.cumsum(left)
                # each text but its last space
                solid = np.ones(len(out), bool)
                solid[ends[left > 0] - 1] = False
                off = np.concatenate([[0], np.cumsum(np.maximum(left - 1, 0))])
                text = pa.LargeStringArray.from_buffers(len(left), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[solid])))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], pa.array(w.counts()), pa.array(n_gone), text.cast(pa.string())], names=names)

    return source.mapInArrow(run, schema).toDF(*outer, *MADE)


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) as i from d where len(w) >= {WINDOW})),
rep as (select g from win group by g having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as p from win join rep using (g)),
word as (select doc_id, p, w[p] as x from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
stay as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from (select * from word anti join gone using (doc_id, p)) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join stay on stay.doc_id = d.doc_id
"""
