"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import jaccard, line_dedup, mixing, pieces, quality
from fleetlens.llm._scratch import deleted, freed_shuffles, freed_tables, new_path


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the used ones under names of their own, which no operator adds; and what names them back."""
    names = {c: c if c in used else f"_own{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, back = _apart(docs, "doc_id", "text")
    return quality.quality_rules(rows).where("kept").select(*back)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated runs of lines and passages of over 50 words; one of which nothing but white space is left goes. n_chars follows the text."""
    rows, back = _apart(docs, "doc_id", "text", "n_chars")
    changed = (F.col("n_removed") > 0) | (F.col("n_passage_words") > 0)
    out = line_dedup.dedup_lines(rows, passage_words=51).where(~(changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; rows without an id belong to none and stay.

    Rows that share that id are one document: all its texts stay, each once (of rows equal in id and text the least stays, by
    its other columns as JSON).
    """
    first = jaccard.near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    rows, back = _apart(docs, "doc_id", "text")
    row = F.struct(F.lit(0).alias("_"), *(c for c in rows.columns if c not in ("doc_id", "text")))
    least = rows.join(first, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("_row"))
    kept = least.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c) for c in rows.columns))
    return kept.unionByName(rows.where("doc_id is null")).select(*back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    rows, back = _apart(docs, "doc_id", "text", "source")
    mixed = mixing.mix_sources(rows).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*back)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document of the mix, two distinct ones where there are two."""
    return pieces.sample_pieces(docs).select("doc_id", "rank", "ids", "n_pieces", "log_prob", "inclusion", "round_trip")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", pieces_stage),
]

#: The mix and the sampled segmentations are draws; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's tables go when its result is written, and that goes when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with freed_tables(spark), freed_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
