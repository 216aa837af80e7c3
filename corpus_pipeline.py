"""A corpus pipeline: five stages, each one operator over all that the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
``run`` writes as Parquet and reads again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.llm import contamination, lines, neardup, packing, toxicity
from pigmenta.llm.common import checkpointed, read, shared_folder, small_side
from pigmenta.llm.queries import tokenizer_path, toxicity_model

TOXIC = 0.7


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored as toxic go."""
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, keep=tuple(docs.columns))
    return scored.where(F.round("score", 6) < TOXIC).select(*(F.col(f"_{c}").alias(c) for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; every document stays."""
    gc.collect()  # the plans of the stage before, with their broadcasts, live on the driver as long as Python holds them
    kept = lines.drop_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, with all its rows; rows without id stay."""
    gc.collect()
    others = small_side(checkpointed(neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()))
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    gc.collect()
    return contamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", toxic_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: Trained weights, hashed signatures and token ids can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
