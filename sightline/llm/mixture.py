"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents stand in the
order of their keys; the keys' leading digits cut each source into ranges of
even size, whatever its share of the rows. Token counts are summed by range,
the ranges' sums are added up in order, so that each range knows its start:
prefix sums without gathering a source anywhere. Each source is then cut at its
exact budget, after whole epochs where the budget exceeds the source. The cut
falls into one range a source, whose documents are summed up one by one; every
other document is before or behind it and is decided where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.frames import cut, kept, table

#: Hex digits of the key that name a range: so many that it holds about RANGE_ROWS documents, LEAST_DIGITS at least.
LEAST_DIGITS, MOST_DIGITS, RANGE_ROWS = 3, 8, 2000
#: Sources whose cuts are broadcast; more are joined.
SOURCES_MOST = 100_000
EPOCHS = 3
#: The weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MADE = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size) with each source's weight and target.

    Weights repeat over the sources by code point, null last. The targets share the
    total by weight and stop at `epochs` times the source; what is over goes to the
    others by weight. That is one level that all uncapped sources share: with the
    sources in ascending order of epochs * size / weight, the highest of what those
    from some source on would get if all before it were capped.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", F.element_at(pick, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the levels rise up to the first source that stays uncapped and fall behind it
    best = F.max("level").over(every)
    return w.withColumn("level", level).select("source", "source_size", "weight", F.least("cap", F.col("weight") * best).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, range_digits: int | None = None) -> DataFrame:
    """One row per row of docs: the columns of keep, size, source_size, target, taken.

    size: the words [^\\x20\\x09-\\x0D]+ of the text, null none. taken: the words the
    mix takes of the document, repeats counted: whole epochs of its source, and of
    the last, partial one the words before the source's budget (rounded down) is
    reached. Null sources are one source, the last. A source without words has
    target zero; equal ids follow each other by size, null ids stand by a hash of
    their text; repeated rows each count; an empty table gives no rows; a kept column
    with an output's name comes out as in_<name>.
    """
    if range_digits is None:
        range_digits = min(max(LEAST_DIGITS, (max(docs.count() // RANGE_ROWS, 1).bit_length() + 3) // 4), MOST_DIGITS)
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    carried = [f"k{i}" for i in range(len(keep))]
    key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit(""))))))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, carried, strict=True)], F.col(f"`{source_col}`").alias("source"), key.alias("key"), size.alias("size"))
    if text_col not in keep:  # narrow rows are counted once; texts are rather read again than written
        rows = cut(rows)
    rows = rows.withColumn("part", F.substring("key", 1, range_digits))
    sums = cut(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")))
    goal = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights=weights, epochs=epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    goal = goal.withColumn("whole", whole).withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    behind = F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.select(F.col("source").alias("s"), F.col("part").alias("cut_part"), (behind - F.col("part_size")).alias("start"), behind.alias("end"))
    cuts = cut(goal.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("end")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "rest", "cut_part", "start"))
    near = rows.join(F.broadcast(cuts) if cuts.count() <= SOURCES_MOST else cuts, F.col("source").eqNullSafe(F.col("s")))
    clear = near.where(F.coalesce(F.col("part") != F.col("cut_part"), F.lit(True))).withColumn("last", F.when(F.col("part") < F.col("cut_part"), F.col("size")).otherwise(F.lit(0)))
    edge = near.where(F.col("part") == F.col("cut_part"))
    inside = F.sum("size").over(Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    edge = edge.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("start") + inside))))
    out = clear.unionByName(edge).select(*carried, "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("last")).cast("long").alias("taken"))
    return out.toDF(*docs.select(*kept(docs, keep, MADE)).columns, *MADE)


def op10_mixture(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = """
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), 'text:' || md5(coalesce(text, '')))) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select source, source_size, ([5.0, 2.0, 1.0]::double[])[(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight, source_size * 3.0::double as cap from s),
l as (select *, (sum(source_size::double) over () - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from w window before as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)),
g as (select source, source_size, least(cap, weight * max(level) over ()) as target from l),
p as (select doc_id, size, source_size, target, sum(size) over (partition by d.source order by key, size, doc_id rows unbounded preceding) - size as ahead
  from d join g on d.source is not distinct from g.source),
b as (select *, floor(target)::bigint as budget, floor(target)::bigint // greatest(source_size, 1) as whole from p)
select doc_id, size, source_size, target, cast(whole * size + greatest(0, least(size, budget - whole * source_size - ahead)) as bigint) as taken from b
"""
