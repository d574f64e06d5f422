"""The quality classifier's sample and threshold against the whole of the labelled documents."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sightline.llm import quality
from sightline.llm.sample import fold


def test_threshold_is_of_all_labelled_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels.where((fold(F.col("doc_id"), 4) != 2) & F.col("quality").isNotNull()), "doc_id").where("text is not null").select("doc_id", "text", "quality").toPandas()
    rows = rows.drop_duplicates("doc_id")
    model = quality.fit(docs, labels, most_rows=20)
    s = np.sort(model.raw(quality.features(pa.array(rows.text))))
    k = int((rows.quality == 0).sum())
    assert len(s) > 20 and np.isclose(model.threshold, (s[k - 1] + s[k]) / 2, rtol=0, atol=1e-9)


def test_a_long_text_does_not_end_the_sample(spark):
    texts = [(i, " ".join(["good plain words here."] * 9) if i % 2 else "!!! BUY | BUY | $$$ " * 9, i % 2) for i in range(60)]
    first = min((i for i, *_ in texts if fold_of(spark, i) != 2), key=lambda i: hash_of(spark, i))
    rows = [(i, t * 60_000 if i == first else t, y) for i, t, y in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert model is not None
    got = quality.score_quality(df.where(F.col("doc_id") != first), model, keep=("doc_id", "quality")).collect()
    assert all(r.predicted == r.quality for r in got)


def fold_of(spark, i):
    return spark.range(i, i + 1).select(fold(F.col("id"), 4)).first()[0]


def hash_of(spark, i):
    return spark.range(i, i + 1).select(F.xxhash64("id")).first()[0]


def test_quantile_at(spark):
    for s in ([3.0, 1.0, 2.0, 2.0, 9.0], [0.0, 1e9, 1e-9, 5.0], [4.0, 4.0], list(np.random.default_rng(3).normal(size=50))):
        df, want = spark.createDataFrame([(float(x),) for x in s], "s double"), sorted(s)
        for k in (1, len(s) // 2, len(s) - 1):
            assert np.isclose(quality.quantile_at(df, k), (want[k - 1] + want[k]) / 2, rtol=0, atol=1e-12)
