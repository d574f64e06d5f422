"""Benchmark decontamination with an FM-index per shard of the documents.

Each task gathers documents into shards, maps their words to the benchmark's
vocabulary and builds an FM-index: a suffix array by prefix doubling, the
Burrows-Wheeler transform as a wavelet matrix, and suffix positions sampled at
every SAMPLE-th place. All windows of the benchmark are searched backward at
once, their occurrences located by walking to sampled positions, and the
occurrences merged to removal spans. Documents are never shuffled.

Words that the benchmark doesn't have can't be in an occurrence; a run of words
that it has can't hold one if it is shorter than the shortest window. Both are
left out of the index, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import textbytes as tb
from sightline.llm.frames import table, with_text, written

WINDOW = 13
SAMPLE = 16
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 2 << 20
#: The benchmark is broadcast in parts of at most so many bytes of text.
PART_BYTES = 4 << 20
#: So many parts are searched in one pass over the documents; a larger benchmark takes several passes.
PARTS_AT_ONCE = 4
MADE = ("n_words", "n_hit", "spans", "item_ids")


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of non-negative integers of which the last is the only zero."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    k = min(max(1, 62 // bits), n)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: n - j] |= t[j:]
    sa = np.argsort(key, kind="quicksort")
    new = np.ones(n, bool)
    s = key[sa]
    new[1:] = s[1:] != s[:-1]
    del s, key
    rank = np.empty(n, np.int64)
    while True:
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[sa] = head
        # rows of groups of more than one
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return sa
        who = sa[tied]
        key = (rank[who] << 32) | rank[np.minimum(who + k, n - 1)]
        order = np.argsort(key, kind="quicksort")
        sa[tied] = who[order]
        key = key[order]
        first = np.ones(len(tied), bool)
        first[1:] = key[1:] != key[:-1]
        new[tied] = first
        k *= 2


class FMIndex:
    """Counts and locates sequences in t: symbols from 1 on, zero as a border that no pattern has."""

    def __init__(self, t: np.ndarray, sample: int = SAMPLE):
        text = np.append(t.astype(np.int64) + 1, 0)
        n = self.n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.levels = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=(1 << self.levels) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.ranks, self.zeros = [], []
        level = bwt
        for b in range(self.levels - 1, -1, -1):
            bit = ((level >> b) & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(n - int(ones[-1]))
            level = np.concatenate([level[~bit], level[bit]])
        marked = sa % sample == 0
        self.marked = np.zeros(n + 1, np.int32)
        np.cumsum(marked, out=self.marked[1:])
        self.sampled = sa[marked]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands among the first i of the transform."""
        lo, hi = np.zeros_like(i), i
        for b, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ranks, self.zeros, strict=True):
            up = ((c >> b) & 1).astype(bool)
            r, s = ones[lo], ones[hi]
            lo, hi = np.where(up, zeros + r, lo - r), np.where(up, zeros + s, hi - s)
        return hi - lo

    def back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that start one place earlier."""
        lo, hi, c = np.zeros_like(row), row, np.zeros_like(row)
        for ones, zeros in zip(self.ranks, self.zeros, strict=True):
            r, s = ones[lo], ones[hi]
            up = (ones[hi + 1] - s).astype(bool)
            c = 2 * c + up
            lo, hi = np.where(up, zeros + r, lo - r), np.where(up, zeros + s, hi - s)
        return self.first[c] + hi - lo

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns of symbols from 1 on."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        top = (1 << self.levels) - 1
        for j in range(patterns.shape[1]):
            live = live[(sizes[live] > j) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, -1 - j] + 1
            known = c <= top
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            at = self.marked[row]
            here = self.marked[row + 1] > at
            out[live[here]] = self.sampled[at[here]] + steps[live[here]]
            live, row = live[~here], self.back(row[~here])
            steps[live] += 1
        return out


class Benchmark:
    """The windows of some benchmark items over their own vocabulary."""

    def __init__(self, ids: list, texts: list[str], window: int = WINDOW):
        w = tb.Words(pa.array(texts, pa.string()), tb.ALNUM, True)
        self.vocabulary, code = np.unique(w.hashes(), return_inverse=True)
        code = code.astype(np.int32) + 1
        place = {i: k for k, i in enumerate(dict.fromkeys(ids))}  # rows of one id are one item
        item = np.array([place[i] for i in ids], np.int64)
        counts = w.counts()
        n = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
        of = np.repeat(item, n)
        size = np.repeat(np.minimum(counts, window), n)
        first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - w.word_off[:-1], n)
        rows = np.zeros((len(first), window), np.int32)  # right-aligned
        for j in range(window):
            i = np.flatnonzero(size > j)
            rows[i, window - 1 - j] = code[first[i] + size[i] - 1 - j]
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.sizes = (self.patterns > 0).sum(1)
        self.least = int(self.sizes.min()) if len(rows) else 0
        pairs = np.unique(np.stack([which.ravel(), of], 1), axis=0)
        self.item_off = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
        self.items = pairs[:, 1]
        self.ids = np.empty(len(place), object)
        self.ids[:] = list(place)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.vocabulary & np.uint64(0xFFFF)] = True

    def codes(self, h: np.ndarray) -> np.ndarray:
        """1.. for the vocabulary's words, zero for others."""
        out = np.zeros(len(h), np.int32)
        i = np.flatnonzero(self.maybe[h & np.uint64(0xFFFF)])
        if len(i):
            at = np.searchsorted(self.vocabulary, h[i])
            at[at == len(self.vocabulary)] = 0
            out[i] = np.where(self.vocabulary[at] == h[i], at + 1, 0)
        return out


class _Shard:
    """Texts whose words wait to be indexed together."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []  # a list for each part of the benchmark
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.counts.append(counts)
        self.words += len(hashes)

    def occurrences(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """First words (counted through the shard) and pattern numbers of all occurrences."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(bench.patterns) or not self.words:
            return none
        code = bench.codes(np.concatenate(self.hashes))
        n = len(code)
        # runs of known words within one text: a border goes before each text's first word
        brk = np.zeros(n + 1, bool)
        brk[np.cumsum(np.concatenate(self.counts))] = True
        brk[0] = True
        known = code > 0
        start = known & (brk[:-1] | ~np.append(False, known[:-1]))
        run = np.cumsum(start) - 1
        sizes = np.bincount(run[known], minlength=int(start.sum()))
        if not len(sizes):
            return none
        place = np.flatnonzero(known & (sizes[np.maximum(run, 0)] >= bench.least))
        if not len(place):
            return none
        first = start[place]
        shift = np.cumsum(first)  # one border before each run
        text = np.zeros(len(place) + int(shift[-1]), np.int64)
        where = np.arange(len(place)) + shift
        text[where] = code[place]
        origin = np.zeros(len(text), np.int64)
        origin[where] = place
        index = FMIndex(text)
        lo, hi = index.search(bench.patterns, bench.sizes)
        found = hi - lo
        which = np.repeat(np.arange(len(lo)), found)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + lo[which]
        return origin[index.locate(rows)], which

    def results(self, parts: list[Benchmark], before: tuple[list, list] | None = None) -> tuple[list, list, list, list]:
        """Words, hit words, spans and items of each text; before: the spans and items that earlier passes found."""
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        off = np.concatenate([[0], np.cumsum(counts)])
        cover = np.zeros(self.words + 1, np.int32)
        items: list[dict] = [{} for _ in counts]
        if before:
            for d, (had, ids) in enumerate(zip(*before, strict=True)):
                items[d].update(dict.fromkeys(ids))
                for x in had:
                    cover[off[d] + x["first"]] += 1
                    cover[off[d] + x["end"]] -= 1
        for bench in parts:
            at, which = self.occurrences(bench)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + bench.sizes[which], -1)
            doc = np.searchsorted(off, at, "right") - 1
            hits = np.unique(np.stack([doc, which], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            n = bench.item_off[hits[:, 1] + 1] - bench.item_off[hits[:, 1]]
            d = np.repeat(hits[:, 0], n)
            k = bench.items[np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bench.item_off[hits[:, 1]], n)]
            for x, y in np.unique(np.stack([d, k], 1), axis=0).tolist() if len(d) else ():
                items[x][bench.ids[y]] = None
        hit = np.cumsum(cover[:-1]) > 0
        n_hit = tb.segment_sums(hit, off)
        # maximal runs of hit words, cut at texts' borders
        edge = np.zeros(self.words + 1, bool)
        edge[off] = True
        before = np.append(False, hit[:-1])
        begins = np.flatnonzero(hit & (~before | edge[:-1]))
        after = np.append(hit[1:], False)
        finish = np.flatnonzero(hit & (~after | edge[1:])) + 1
        doc = np.searchsorted(off, begins, "right") - 1
        spans: list[list] = [[] for _ in counts]
        for d, a, b in zip(doc.tolist(), (begins - off[doc]).tolist(), (finish - off[doc]).tolist(), strict=True):
            spans[d].append({"first": a, "end": b})
        return counts.tolist(), n_hit.tolist(), spans, [list(x) for x in items]


def _parts(benchmark: DataFrame, item_col: str, text_col: str, window: int, part_bytes: int) -> Iterator[Benchmark]:
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
        if size > part_bytes:
            yield Benchmark(ids, texts, window)
            ids, texts, size = [], [], 0
    yield Benchmark(ids, texts, window)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",), item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row per row of docs: the columns of keep, n_words, n_hit, spans, item_ids.

    The benchmark reaches the driver one part at a time; PARTS_AT_ONCE parts are
    broadcast for a pass, and where there are more, passes follow each other over a
    written table, each adding to the spans and items before it.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased. spans: the
    merged ranges [first, end) of words inside occurrences of benchmark windows;
    item_ids: the items with occurring windows, each once, however many benchmark rows
    have its id; the rows with a null id are one item, whose id is null.
    A null or empty text has no words and no spans; a benchmark item without words
    has no window; an empty benchmark hits nothing; repeated rows each come out; a
    kept column with the name of an output comes out as in_<name>. A text is never
    cut: a shard ends between texts.
    """
    source, at, own = with_text(docs, keep, MADE, text_col)
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", span), T.StructField("item_ids", T.ArrayType(benchmark.schema[item_col].dataType))]
    found = source.toDF(*[f"c{i}" for i in range(len(source.columns))])
    parts = _parts(benchmark, item_col, item_text_col, window, part_bytes)
    now = list(islice(parts, PARTS_AT_ONCE))
    while now:
        after = list(islice(parts, PARTS_AT_ONCE))
        found = _search(found, at, made, now, len(source.columns) if after else len(own))
        if after:
            found = written(found, "decontamination")
        now = after
    return found.toDF(*own, *MADE)


def _search(source: DataFrame, at: int, made: list[T.StructField], parts: list[Benchmark], n_out: int) -> DataFrame:
    """The first n_out columns of source (c0, c1, ...) and the columns made, of these parts and of the passes before."""
    sent = source.sparkSession.sparkContext.broadcast(parts)
    again = made[0].name in source.columns
    if again:
        source = source.drop("n_words", "n_hit")
    schema = T.StructType(source.schema.fields[:n_out] + made)
    kept_columns = [*range(n_out), *([len(source.columns) - 2, len(source.columns) - 1] if again else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        shard, rows = _Shard(), []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, rows
            before = tuple([x for r in rows for x in r.column(r.num_columns - 2 + j).to_pylist()] for j in (0, 1)) if again else None
            out = shard.results(sent.value, before)
            done = 0
            for r in rows:
                n = r.num_rows
                cols = r.columns[:n_out] + [pa.array(x[done : done + n], arrow.field(n_out + j).type) for j, x in enumerate(out)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                done += n
            shard, rows = _Shard(), []

        for batch in batches:
            texts = batch.column(at)
            for a, b in tb.blocks(texts, BLOCK_BYTES):
                w = tb.Words(texts.slice(a, b - a), tb.ALNUM, True)
                shard.add(w.hashes(), w.counts())
                rows.append(batch.slice(a, b - a).select(kept_columns))
                if shard.words >= SHARD_WORDS:
                    yield from flush()
        if rows:
            yield from flush()

    return source.mapInArrow(run, schema)


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["first"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), spans.alias("spans")
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
with b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, least(len(w), {WINDOW}) as k, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
ks as (select distinct k from bw),
dw as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
hit as (select doc_id, i, dw.k as k, item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
place as (select distinct doc_id, unnest(range(i, i + k)) as p from hit),
runs as (select doc_id, min(p) as a, max(p) as z from (select doc_id, p, p - row_number() over (partition by doc_id order by p) as run from place) group by doc_id, run),
n as (select doc_id, sum(z - a + 1) as n_hit, string_agg((a - 1) || '-' || z, ',' order by a) as spans from runs group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(it.s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
  coalesce(n.spans, '') as spans
from d left join n on n.doc_id = d.doc_id left join it on it.doc_id = d.doc_id
"""
