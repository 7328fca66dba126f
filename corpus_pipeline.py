"""Training corpus in five stages, each of which is one operator over all rows its predecessor kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which `run` writes
as Parquet to the cluster's shared folder and reads again for the next stage, so
a lost executor costs at most one stage and plans stay short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.decontaminate import drop_contaminated
from opsloom.llm.exact_dedup import drop_exact_duplicates
from opsloom.llm.near_dedup import drop_near_duplicates
from opsloom.llm.quality_knn import quality_model, score_quality
from opsloom.llm.sentence_sampling import sample_segmentations
from opsloom.llm.shared import free_names, shared_folder, table

#: A document whose quality score is below this goes.
QUALITY_LEAST = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote doesn't reject; learned from the labelled rows of `docs` whose fold of five isn't 0.

    Null and empty texts are scored as any other. Extra columns are kept.
    """
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    score, = free_names(docs, "score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= QUALITY_LEAST).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts, the row with the smallest doc_id; null and empty texts are one group."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest doc_id; texts without words all stay."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null texts have none and stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each text: doc_id, sample, ids (little-endian 32-bit), log_prob, perturbed, log_inclusion, exact."""
    return sample_segmentations(docs, packed=True, checked=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("sentencepiece", encode)]

#: Neighbour votes in floating point and sampled segmentations have no SQL. Tests hold the first stage against votes written
#: out one by one, the next three against SQL, and the last against its texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the intermediate tables lie in the folder of spark.checkpoint.dir."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}_{name}")
            docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
