"""A bounded, repeatable sample of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", most: dict[int, tuple[int, int]]) -> tuple[list[str], list[int]]:
    """Texts and labels of at most most[label] = (rows, bytes of text) documents of each label.

    Rows are taken by a hash of the id. allowed: a condition on the labels' doc_id.
    A text that doesn't fit into what is left of the bytes is passed over, the next
    ones are not. Of rows with one id any may serve; the texts are chosen in the
    order of (hash, id, text), so reruns agree. Null ids, labels and texts are left
    out. Both labels are looked up in one scan of the documents.
    """
    spark = docs.sparkSession
    base = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("o"))
    rows = {r.id: (r.y, r.o) for y, (n, _) in most.items() for r in base.where(F.col("y") == y).orderBy("o", "id").limit(n).collect()}
    if not rows:
        return [], []
    ids = spark.createDataFrame([(k, y, o) for k, (y, o) in rows.items()], base.select("id", "y", "o").schema)
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(ids), "id")
    left = {y: size for y, (_, size) in most.items()}
    chosen = []
    for r in found.select("id", "o", "y", F.octet_length("t").alias("n")).groupBy("id", "o", "y").agg(F.max("n").alias("n")).orderBy("o", "id").collect():
        if r.n <= left[r.y]:
            left[r.y] -= r.n
            chosen.append((r.id,))
    pick = spark.createDataFrame(chosen, base.select("id").schema)
    texts = found.join(F.broadcast(pick), "id").groupBy("id", "o", "y").agg(F.min("t").alias("t")).orderBy("o", "id").collect()
    return [r.t for r in texts], [r.y for r in texts]
