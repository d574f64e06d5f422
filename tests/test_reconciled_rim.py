"""A surface's scores end at its rim, within reach or not."""

import pytest
from pyspark.sql import functions as F

from sightline import registry
from sightline.operators import meshes as M
from tests.compare import rows


def test_beside_a_triangle(spark):
    """Beside the rim, over it, under it, at a corner, and near a triangle without an area."""
    v = "struct<x:double,y:double,z:double>"
    flat = (0, "o", (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), 0.0, 1.0, 1.0)
    none = (1, "o", (0.5, 0.0, 0.0), (0.5, 0.0, 0.0), (0.5, 0.0, 0.0), 0.3, 0.3, 0.3)
    tri = spark.createDataFrame([flat, none], f"tri int, owner string, a {v}, b {v}, c {v}, va double, vb double, vc double")
    at = [(-0.25, 0.5, 0.0), (0.25, 0.25, 0.4), (0.25, 0.25, -0.4), (1.0, 0.0, 0.0), (0.5, -0.1, 0.0)]
    targets = spark.createDataFrame([(i, p, None) for i, p in enumerate(at)], f"id int, p {v}, score double")
    got = {r.id: r.score for r in M.reconciled(targets, tri, cell=1.0, reach=0.5).collect()}
    assert got == {0: None, 1: pytest.approx(0.5), 2: pytest.approx(0.5), 3: pytest.approx(1.0), 4: None}


def test_j15_beyond_the_last_strip(spark, sf, tmp_path):
    """Against the query's SQL where there are points up to 2 beyond the last strip."""
    duckdb = pytest.importorskip("duckdb")
    spark.range(1, 24_320).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{sf}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    c = duckdb.connect()
    c.sql(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = registry.queries()["j15_reconciled"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.sql(registry.oracle_sql()["j15_reconciled"]).df())
