"""From documents to a training mixture, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Labels and benchmark are read from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, mixture, quality, simhash, substrings
from sightline.llm.frames import table, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named d0, d1, ..., so that no name clashes with what an operator makes, and the new names by the old ones."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null and empty texts are scored from their zero counts; without labels of both
    kinds every document stays; repeated rows share one decision.
    """
    own, at = _numbered(docs)
    model = quality.fit(own, table(spark, sf_dir, "labels"), id_col=at["doc_id"], text_col=at["text"])
    scored = quality.score_quality(own, model, text_col=at["text"], keep=own.columns)
    return scored.where("predicted = 1").select(*own.columns).toDF(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, null ids last.

    Null and empty texts are one group; of rows alike in id and text one stays.
    """
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows, and their new n_chars; texts that have none stay as they are, null ones too.

    A text of which nothing is left stays as an empty one.
    """
    own, at = _numbered(docs)
    text, n_chars = at["text"], at["n_chars"]
    out = substrings.remove_repeated(own, id_col=at["doc_id"], text_col=text, keep=own.columns)
    changed = F.col("n_removed") > 0
    new = {text: F.when(changed, F.col("kept_text")).otherwise(F.col(text)), n_chars: F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col(n_chars))}
    return out.select(*[new.get(n, F.col(n)).alias(n) for n in own.columns]).toDF(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the benchmark contaminates; those without words stay, and without a benchmark all do."""
    own, at = _numbered(docs)
    found = decontaminate.find_contamination(own, table(spark, sf_dir, "benchmark"), text_col=at["text"], keep=own.columns)
    return found.where(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(*own.columns).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes words of, with size, source_size, target and taken.

    Those without words are never taken. A column of documents with one of these names comes out as in_<name>.
    """
    return mixture.mix(docs, keep=docs.columns).where("taken > 0")


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

#: The classifier and the fingerprints can't be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
