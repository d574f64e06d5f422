"""Quality rules in built-in expressions.

Base rules look at repeated windows, lines and symbols of a text. Beyond them, a
document's hashed uni- and bigrams are weighed by the log-likelihood ratio of
two multinomials, one of half of the trusted documents and one of the whole
corpus; the sum over the document's n-grams is divided by their number, and every
document at or above one threshold is kept. The threshold is a quantile of the
scores of the other half of the trusted documents. The multinomials' buckets grow
with the number of documents, up to MOST_BITS.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.frames import cut, kept, table, words_of

WINDOW = 8
#: 2**bits buckets: as many bits as the number of documents over DOCS_A_BUCKET has, within these bounds.
LEAST_BITS, MOST_BITS, DOCS_A_BUCKET = 12, 18, 4
#: Trusted ids are broadcast up to so many; more are joined.
BROADCAST_IDS = 1_000_000
QUANTILE = 0.005
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _neighbours(h: Column, gap: int) -> Column:
    """A hash of every value with the one `gap` places behind it."""
    return F.transform(F.slice(h, F.lit(gap + 1), F.greatest(F.size(h) - gap, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), x))


def buckets(h: Column, n: int, two: Column | None = None) -> Column:
    """The buckets of the uni- and bigrams of hashed words; two: the bigrams' hashes, where they are at hand."""
    return F.transform(F.concat(h, _neighbours(h, 1) if two is None else two), lambda x: F.pmod(x, F.lit(n)).cast("int"))


def bucket_count(n_docs: int) -> int:
    return 1 << min(max(LEAST_BITS, (n_docs // DOCS_A_BUCKET).bit_length()), MOST_BITS)


def base_columns(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __h, __2 (hashed words and bigrams) and the base rules' numbers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("__w", words_of(F.col(text_col)))
    d = d.withColumn("__h", _hashes(F.col("__w"))).withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long")).drop("__w")
    d = d.withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("__l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")).drop("__l")
    # hashes of two, four and eight words, each of two of half as many
    d = d.withColumn("__2", _neighbours(F.col("__h"), 1)).withColumn("__4", _neighbours(F.col("__2"), 2)).withColumn("__g", _neighbours(F.col("__4"), 4)).drop("__4")
    g = F.col("__g")
    # only texts with a repeated window are sorted
    pairs = F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("__s", pairs).drop("__g")
    s = F.col("__s")
    same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (same(i, i + 1) | same(i, i - 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(places, start, step, lambda a: a["n"]), F.lit(0)).cast("long")).drop("__s")
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def ratios(rows: DataFrame, n: int) -> list[float]:
    """log p(bucket | trusted) - log p(bucket | corpus), with add-one smoothing, of rows (h, t: 1 if trusted).

    Two numbers a bucket come to the driver, whatever the corpus' size.
    """
    counts = rows.select(F.explode(buckets(F.col("h"), n)).alias("b"), "t").groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("trusted")).collect()
    raw, good = [1] * n, [1] * n
    for r in counts:
        raw[r.b] += r.raw
        good[r.b] += r.trusted
    a, b = math.log(sum(raw)), math.log(sum(good))
    return [round(math.log(g) - b - math.log(r) + a, 6) for g, r in zip(good, raw, strict=True)]


def score_of(h: Column, table_: list[float], two: Column | None = None) -> Column:
    """The mean ratio over a text's n-grams; zero for none."""
    held = F.from_json(F.lit(json.dumps(table_)), "array<double>")
    f = buckets(h, len(table_), two)
    return F.coalesce(F.try_divide(F.aggregate(f, F.lit(0.0), lambda s, b: s + F.get(held, b)), F.greatest(2 * F.size(h) - 1, F.lit(0)).cast("double")), F.lit(0.0))


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep=("doc_id",), quantile: float = QUANTILE) -> DataFrame:
    """One row per row of docs: the columns of keep, the base numbers, base_failed, kept, score.

    labels (doc_id, quality): documents with quality 1 are trusted; the half of them
    with an even hash of the id fills the trusted multinomial, the other half, where
    it has 20 words or more, sets the threshold. Null and empty texts have no words
    and fail the base rules; without trusted documents all that pass the base rules
    are kept; repeated rows each come out and count; an empty table gives no rows; a
    kept column with an output's name comes out as in_<name>.
    """
    n = bucket_count(docs.count())
    ids = cut(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct().withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2))))
    few = ids.count() <= BROADCAST_IDS
    half = lambda k: F.broadcast(ids.where(F.col("half") == k)) if few else ids.where(F.col("half") == k)
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = text.join(half(0), "id", "left").select(_hashes(words_of(F.col("text"))).alias("h"), F.when(F.col("half").isNotNull(), 1).otherwise(0).alias("t"))
    weights = ratios(marked, n)
    seen = text.join(half(1), "id", "left_semi").select(_hashes(words_of(F.col("text"))).alias("h")).where(F.size("h") >= 20)
    least = seen.agg(F.percentile(score_of(F.col("h"), weights), F.lit(quantile)).alias("q")).first().q
    carried = [f"k{i}" for i in range(len(keep))]
    d = base_columns(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, carried, strict=True)], F.col(f"`{text_col}`").alias("text")), "text")
    d = d.withColumn("score", score_of(F.col("__h"), weights, F.col("__2")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(float("-inf") if least is None else float(least))))
    return d.select(*carried, *MADE).toDF(*docs.select(*kept(docs, keep, MADE)).columns, *MADE)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
