"""Exact deduplication by content sort.

Normalised texts are range-partitioned by sampled splitters, sorted externally
inside each range, and runs of neighbours that compare equal keep the row with
the smallest identifier. DataFrame functions only.

The splitters are compared on the first bytes of the text and its digest, so
they stay short however long texts are; inside a range the whole texts decide.
A text that would fill more than a range of its own is dealt over several
ranges by a salt, and its runs are put together from sums made before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names, shuffle_partitions, table

#: Characters of a text that the range splitters look at before its digest.
SPLIT_CHARS = 32
#: Share of rows that is looked at for texts that are too frequent for one range.
SAMPLE = 0.02
#: Times a text must occur in the sample before it can count as frequent.
SEEN = 5


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _frequent(docs: DataFrame, text_col: str, ranges: int, seed: int) -> list[str]:
    """Digests of texts that the sample shows to hold more rows than a range should.

    Fewer than 2 * `ranges` by construction. They decide how rows are dealt, not what is returned.
    """
    seen = docs.select(text_col).sample(SAMPLE, seed)
    seen = seen.select(F.sha2(normalised(F.col(text_col)), 256).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    rows = seen.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "d").limit(2 * ranges).collect()
    if not rows:
        return []
    size = seen.agg(F.sum("n")).first()[0]
    return [r["d"] for r in rows if r["n"] * 2 * ranges >= size]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Group rows whose normalised texts are identical.

    Returns one row per input row: `id_col`, `keep_id` (smallest identifier of
    the group), `group_size`, `kept`, `text_sha256`. Null text counts as empty,
    so null, empty and equal rows form one group; texts of white space only
    become one space and form another. Rows with the same identifier and text
    are all returned, and all kept when theirs is the smallest identifier. A
    null identifier is larger than any other. An empty table gives an empty
    result. Other columns of the input are not looked at.
    """
    ranges = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("_digest", F.sha2("_text", 256))
    hot = _frequent(docs, text_col, ranges, seed)
    order = ["_digest"]
    if hot:
        salt = F.pmod(F.xxhash64("_id"), F.lit(2 * ranges)).cast("int")
        rows = rows.withColumn("_salt", F.when(F.col("_digest").isin(hot), salt).otherwise(0))
        order.append("_salt")
    rows = rows.withColumn("_head", F.substring("_text", 1, SPLIT_CHARS))
    # The range exchange satisfies the window's distribution: equal texts meet after one shuffle, sorted by content.
    run = Window.partitionBy("_head", *order, "_text")
    found = rows.repartitionByRange("_head", *order).select(
        "_id", "_digest", F.min("_id").over(run).alias("_keep"), F.count(F.lit(1)).over(run).alias("_size")
    )
    if hot:
        # One row for each frequent text and task leaves the map side.
        whole = rows.where(F.col("_digest").isin(hot)).groupBy("_digest", "_text").agg(F.min("_id").alias("_keep_all"), F.count("*").alias("_size_all"))
        found = found.join(F.broadcast(whole.drop("_text")), "_digest", "left")
        found = found.withColumn("_keep", F.coalesce("_keep_all", "_keep")).withColumn("_size", F.coalesce("_size_all", "_size"))
    return found.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_digest").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with all their columns.

    Rows that share an identifier are each judged by their own text; equal rows that are kept all stay.
    """
    own_id, own_digest = free_names(docs, "kept_id", "kept_digest")
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(own_id), F.col("text_sha256").alias(own_digest)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.sha2(normalised(F.col(text_col)), 256) == F.col(own_digest)), "left_semi")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact copies among all of `documents`."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
