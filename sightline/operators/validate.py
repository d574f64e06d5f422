"""Validation rules, surrogate keys, staged updates and resumable chunks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.order import placed


def _conditions(rules: Mapping[str, Column | str]) -> dict[str, Column]:
    return {n: F.expr(c) if isinstance(c, str) else c for n, c in rules.items()}


def row_rules(rows: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """One row per rule (a condition or its SQL): how many rows break it (null counts as broken), of how many, and whether none does. One pass."""
    broken = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in _conditions(rules).items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])).alias("r")
    return broken.select("rows", each).select("r.rule", "r.broken", "rows", (F.col("r.broken") == 0).alias("valid"))


def with_violations(rows: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """rows with `violations`: the names of the rules that each breaks."""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in _conditions(rules).items()])))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose non-null key the parent hasn't."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def completeness(expected: DataFrame, found: DataFrame, key: Sequence[str], kind: str) -> DataFrame:
    """Each kind's expected, found and missing counts and whether it is complete."""
    have = found.select(*key, kind).distinct().withColumn("__f", F.lit(1))
    j = expected.select(*key, kind).distinct().join(have, [*key, kind], "left")
    return j.groupBy(kind).agg(F.count(F.lit(1)).alias("expected"), F.count("__f").alias("found")).withColumn("missing", F.col("expected") - F.col("found")).withColumn("complete", F.col("missing") == 0)


def stable_ids(names: DataFrame, known: DataFrame, name: str, id: str) -> DataFrame:
    """(name, id): names keep their least known id; new ones go on from the greatest, in name order."""
    old = known.groupBy(name).agg(F.min(id).alias("old"))
    top = known.agg(F.coalesce(F.max(id), F.lit(0)).alias("top"))
    j = names.select(name).distinct().join(old, name, "left")
    fresh = placed(j.where("old is null").select(name), [name]).crossJoin(F.broadcast(top)).select(name, (F.col("top") + F.col("place")).cast("long").alias(id))
    return j.where("old is not null").select(name, F.col("old").cast("long").alias(id)).unionByName(fresh)


def append_with_ids(old: DataFrame, new: DataFrame, id: str, order: Sequence[str]) -> DataFrame:
    """old and, behind it, new with ids that go on from the greatest."""
    top = old.agg(F.coalesce(F.max(id), F.lit(-1)).alias("top"))
    numbered = placed(new, order).crossJoin(F.broadcast(top)).withColumn(id, (F.col("top") + F.col("place")).cast(dict(old.dtypes)[id]))
    return old.unionByName(numbered.select(*old.columns))


def promote(final: DataFrame, preview: DataFrame, name: str) -> DataFrame:
    """final and those rows of preview whose name is new."""
    return final.unionByName(preview.join(final.select(name), name, "left_anti").select(*final.columns))


def upsert(table: DataFrame, changes: DataFrame, key: Sequence[str], order: str, delete: str) -> DataFrame:
    """The table after the changes: by key the last change wins; one that deletes removes the row."""
    last = changes.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
    kept = table.join(last.select(*key), list(key), "left_anti")
    return kept.unionByName(last.where(~F.col(delete)).select(*table.columns))


def chunk(frames: DataFrame, id: str, done: str, size: int) -> DataFrame:
    """One row: the first frame that isn't done, the chunk's end, and whether all are done."""
    a = frames.agg(F.min(F.when(~F.col(done), F.col(id))).alias("start"), F.max(id).alias("last"), F.count_if(~F.col(done)).alias("open"))
    return a.select("start", F.least(F.col("start") + size - 1, F.col("last")).alias("end"), "open", (F.col("open") == 0).alias("finished"))


def all_match(rows: DataFrame, column: str, want: Column) -> DataFrame:
    """One row: whether every row's value equals the one wanted; true for none."""
    return rows.agg(F.coalesce(F.bool_and(F.col(column).eqNullSafe(want)), F.lit(True)).alias("match"), F.count_distinct(column).alias("kinds"))


def closure(wanted: DataFrame, needs: Mapping[str, Sequence[str]], column: str) -> DataFrame:
    """wanted with `required`: all outputs that the wanted ones need, through any number of steps."""
    full = {}
    for k in {*needs, *(x for v in needs.values() for x in v)}:
        seen, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += needs.get(x, ())
        full[k] = sorted(seen)
    table = F.create_map(*[x for k, v in sorted(full.items()) for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return wanted.withColumn("required", F.array_sort(F.array_distinct(F.flatten(F.transform(column, lambda c: F.coalesce(F.get(F.array(F.element_at(table, c)), 0), F.array(c)))))))


def log_faults(lines: DataFrame, text: str, patterns: Mapping[str, str], ignore: Sequence[str] = ()) -> DataFrame:
    """lines with `faults`: the names of the patterns found, without ignored ones."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return lines.withColumn("faults", F.array_except(hits, F.array(*[F.lit(i) for i in ignore]).cast("array<string>")))


def image_kind(content: Column) -> Column:
    """png, jpeg or exr by the first bytes (and for jpeg the last two), else null; for files as binary."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(h == "89504E470D0A1A0A", "png").when(F.startswith(h, F.lit("FFD8")) & (F.hex(F.substring(content, -2, 2)) == "FFD9"), "jpeg").when(F.startswith(h, F.lit("762F3101")), "exr")


def last_operations(log: DataFrame, key: str, order: str, keep: int = 50) -> DataFrame:
    """The last `keep` operations of each key, as an undo log holds them."""
    return log.withColumn("depth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("depth") <= keep)


def finished_stroke(history: DataFrame, before: DataFrame, after: DataFrame, *, id: str = "id", keep: int = 50) -> DataFrame:
    """history (stroke, id, added) with what a stroke changed between two selections, as its newest; only the last `keep` strokes stay. A stroke that changed nothing leaves no trace."""
    a, b = before.select(id).distinct(), after.select(id).distinct()
    change = b.join(a, id, "left_anti").withColumn("added", F.lit(True)).unionByName(a.join(b, id, "left_anti").withColumn("added", F.lit(False)))
    top = history.agg(F.coalesce(F.max("stroke"), F.lit(0)).alias("top"))
    fresh = change.crossJoin(F.broadcast(top)).select((F.col("top") + 1).cast("long").alias("stroke"), id, "added")
    both = history.select(F.col("stroke").cast("long").alias("stroke"), id, "added").unionByName(fresh)
    last = both.agg(F.max("stroke").alias("last"))
    return both.crossJoin(F.broadcast(last)).where(F.col("stroke") > F.col("last") - keep).drop("last")
