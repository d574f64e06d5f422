"""Joins of the pipeline's stages whose sides grow with the corpus are merged."""

from sightline.llm import quality, substrings


def test_growing_joins_are_merged(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(i, words if i % 2 else f"other {i}") for i in range(6)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int").write.parquet(str(tmp_path / "l"))
    docs, labels = (spark.read.parquet(str(tmp_path / n)) for n in "dl")
    from pyspark.sql import functions as F

    for out in (quality.labelled_features(docs, labels, F.lit(True)), substrings.remove_repeated(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
