"""Fixity audit of WARC replicas with Merkle trees over ordered offset ranges.

An archive stores records in order, each at a byte offset. Records are hashed,
digests hashed by ranges of LEAF_BYTES of the offset, and those by FANOUT, up to
one root. Two replicas are compared from their roots down; only the children of
differing nodes are looked at, and only the records of differing ranges are
compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.frames import cut, table, written

LEAF_BYTES = 64 << 10
FANOUT = 16


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.0 response record; null parts count as empty."""
    b = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(b).cast("string"), F.lit("\r\n\r\n"), b, F.lit("\r\n\r\n"),
    )


def store(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """The stored archive (seq, record_id, record): records in the order of id and url, null ids first.

    seq orders the records; its upper bits name the file. Repeated rows are records
    of their own. An empty table gives an empty archive.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).alias("u"), F.col(body_col).alias("b")).repartitionByRange(n, "record_id", "u").sortWithinPartitions("record_id", "u", "b")
    return written(rows.select(F.monotonically_increasing_id().alias("seq"), "record_id", warc_record(F.col("record_id"), F.col("u"), F.col("b")).alias("record")), "archive")


def manifest(archive: DataFrame) -> DataFrame:
    """seq, record_id, length, digest, and offset: the bytes of all records before.

    Lengths are summed by file, the files' sums added up in order, and each file
    counts on from its start.
    """
    rows = cut(archive.select("seq", "record_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), F.shiftrightunsigned("seq", 33).alias("file")))
    sums = rows.groupBy("file").agg(F.sum("length").alias("size"))
    start = sums.select("file", F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.sum("length").over(Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return rows.withColumn("inside", inside).join(F.broadcast(start), "file").select("seq", "record_id", "length", "digest", (F.col("start") + F.col("inside")).alias("offset"))


def _gather(rows: DataFrame, node: Column, *fields: str) -> DataFrame:
    """(node, digest): the hash of a node's rows, each written with all its fields, the place first; a null counts as -."""
    inner = F.sort_array(F.collect_list(F.struct(*fields)))
    line = lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])
    return rows.groupBy(node.alias("node")).agg(F.sha2(F.array_join(F.transform(inner, line), ","), 256).alias("digest"))


def tree(records: DataFrame, total: int, *, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """The tree's levels (node, digest) from the leaves' ranges to the root, of records (offset, digest, n)."""
    levels = [cut(_gather(records, F.floor(F.col("offset") / leaf_bytes).cast("long"), "offset", "digest", "n"))]
    nodes = max(1, -(-total // leaf_bytes))
    while nodes > 1:
        levels.append(cut(_gather(levels[-1], F.floor(F.col("node") / fanout).cast("long"), "node", "digest")))
        nodes = -(-nodes // fanout)
    return levels


def audit(own: DataFrame, replica: DataFrame, *, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """offset, status of the records that differ: corrupt, missing (in the replica) or extra (only there).

    own, replica: (offset, digest). A node's hash binds its records' offsets, digests
    and numbers, a null digest too. Equal roots end the audit with no rows. Otherwise
    it goes down one level at a time, to the children of differing nodes alone. An
    offset comes out once: missing or extra if one side has no record there, corrupt
    if the records there, counted, are not the same. Null offsets take no part; an
    empty side makes all records of the other differ.
    """
    own, replica = (d.where("offset is not null").groupBy("offset", "digest").agg(F.count(F.lit(1)).alias("n")) for d in (own, replica))
    ends = [r or 0 for d in (own, replica) for r in d.agg(F.max("offset")).first()]
    a, b = (tree(d, max(ends) + 1, leaf_bytes=leaf_bytes, fanout=fanout) for d in (own, replica))
    bad = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if bad is not None:
            below = bad.withColumnRenamed("node", "parent")
            x, y = (d.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(below, "parent", "left_semi").drop("parent") for d in (x, y))
        bad = cut(x.alias("x").join(y.alias("y"), "node", "full").where(~F.col("x.digest").eqNullSafe(F.col("y.digest"))).select("node"))
        if bad.isEmpty():
            break
    at = F.floor(F.col("offset") / leaf_bytes).cast("long")
    sides = [d.withColumn("node", at).join(bad, "node", "left_semi").select("offset", "digest", F.lit(side).alias("side"), "n") for side, d in enumerate((own, replica))]
    each = sides[0].unionByName(sides[1]).groupBy("offset", "digest").agg(*[F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    found = each.groupBy("offset").agg(F.max(F.col("n0") != F.col("n1")).alias("differs"), F.sum("n0").alias("here"), F.sum("n1").alias("there")).where("differs")
    return found.select("offset", F.when(F.col("there") == 0, "missing").when(F.col("here") == 0, "extra").otherwise("corrupt").alias("status"))


def op3_fixity_audit(spark, sf_dir: str) -> DataFrame:
    """Every page as a stored record, audited against a replica in which one record in 256 has a changed byte and as many are lost."""
    archive = store(table(spark, sf_dir, "pages"))
    held = cut(manifest(archive))
    lot = F.substring(F.md5(F.coalesce(F.col("record_id").cast("string"), F.lit(""))), 1, 2)
    damaged = archive.where(lot != "01").withColumn("record", F.when(lot == "00", F.concat(F.lit("V"), F.substring(F.col("record"), 2, 1 << 30))).otherwise(F.col("record")))
    there = damaged.select("seq", F.sha2("record", 256).alias("digest")).join(held.select("seq", "offset"), "seq")
    found = audit(held, there)
    return held.join(found, "offset", "left").select(F.col("record_id").alias("page_id"), "offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"))


OP3_SQL = r"""
with r as (select page_id, url, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || coalesce(cast(page_id as varchar), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record from pages)
select page_id, cast(sum(strlen(record)) over (order by page_id nulls first, url nulls first, html nulls first rows unbounded preceding) - strlen(record) as bigint) as "offset", cast(strlen(record) as bigint) as length, sha256(record) as digest,
  case left(md5(coalesce(cast(page_id as varchar), '')), 2) when '00' then 'corrupt' when '01' then 'missing' else 'intact' end as status
from r
"""
