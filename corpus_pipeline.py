"""A corpus pipeline: quality classifier, line dedup, near-duplicate removal, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
Nulls in any column, empty texts, repeated rows and extra columns are treated as the operators say; a row whose
doc_id is null is never a near duplicate and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, common, decontaminate, line_dedup, ngram_join, quality
from ledgerloom.llm.langid import learnable

#: Ids that may be sent to all tasks, 8 bytes each; beyond it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier predicts to be of label 1."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"), learnable("doc_id", 4, 2))
    out = common.unused(docs, "_score")
    return quality.score(docs, model, out=out).where(F.col(out) >= quality.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that 10 or more of them have; n_chars follows the text."""
    kept = line_dedup.LineIndex.build(docs).drop_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of rows that share an id the one with the smallest text (null first)."""
    found = ngram_join.join(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    row, rest = common.unused(docs, "_row"), ["text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    first = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias(row))
    return first.select("doc_id", f"{row}.*").select(*docs.columns).unionByName(kept.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no item of the benchmark."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of byte-level BPE ids, and digests of the ids and of their decoding."""
    return byte_bpe.round_trip(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: The classifier and the tokeniser have no SQL form. Tests compare lines, near duplicates and decontamination with brute force,
#: ids with another library, and the classifier's decisions with held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage saves on its way is deleted once its own rows are written, those once the next are; the last ones stay."""
    docs = common.table(spark, sf_dir, "documents")
    with common.Scratch() as stages:
        for name, stage in STAGES[:-1]:
            with common.Scratch() as own:
                docs = own.result(stage(spark, docs, sf_dir), name)
            stages.forget(keep=1)
        return stages.result(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
