"""From raw documents to packed sequences, in five stages.

Each stage takes all that the one before kept. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import lines, mixing, packing, quality, simhash
from plumbline.shared import written

#: SQL can't express the classifier, the fingerprints' search, the schedule or the packing.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, doesn't reject.

    A null or empty text has the score of the bias. Repeated rows are judged alike. Without labels nothing is learned
    and every score is a half, so all rows stay. Columns named like the classifier's results are kept as they were.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    scored = quality.score(whole, *quality.train(docs.select("doc_id", "text"), labels))
    return scored.where(F.col("predicted") == 1).select("row.*")


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; ``n_chars`` follows the text.

    A null text stays null. Each row stays, repeated ones too. Columns named like the operator's results are kept.
    """
    kept = lines.drop_shared_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"), F.col("text").isNull().alias("none")))
    text = F.when(~F.col("none"), F.col("kept_text"))
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id, null ids last.

    Null, empty and white texts are one class, of fingerprint zero. Of repeated rows one stays.
    """
    return simhash.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of a mix of the sources to their target weights.

    A null source is a source of its own. Repeated rows all stay. The order is that of the files' names and rows.
    """
    whole = docs.select("source", F.struct(*docs.columns).alias("row"))
    return mixing.in_order(mixing.mix(whole, mixing.size_weights(docs))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 ids, numbered in the order that ``docs`` was written in.

    Where ``docs`` isn't read from files, there is no order to follow. Null and empty texts are one id. Repeated rows are
    packed each for itself; columns other than doc_id and text take no part. An empty table gives no rows.
    """
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        order = ("file", "row") if placed.columns else None
    except AnalysisException:
        placed, order = docs, None
    return packing.pack(packing.token_pieces(placed, packing.tokenizer_path(), keep=order or ()), order=order)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_shared_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    Each row of ``documents`` goes through the stages' rules for nulls, repeats and ties; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
