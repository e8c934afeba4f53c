"""X1: exact copies of texts.

Of the rows with the same text the one with the lowest id stays (a null id only if there is no other). Texts are equal if all
their characters are. A null text is no copy of anything, so all its rows stay; the empty text is a text like others. Rows
that repeat an id with another text are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, table


def kept(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id and n_copies (rows of that text, its own among them) of the rows that stay.

    Only ids and hashes of all rows are shuffled, summed up in each task first. The texts themselves are compared where a hash
    repeats: grouping by hash and text also starts in each task, so of a text with many copies few rows meet."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", hashed(F.col("text")).alias("h"))
    groups = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
    once, often = groups.where("n_copies = 1").select("doc_id", "n_copies"), groups.where("n_copies > 1").select("h")
    compared = rows.join(often, "h").groupBy("h", "text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
    bare = docs.where(F.col("text").isNull()).select("doc_id", F.lit(1).cast("bigint").alias("n_copies"))
    return once.unionAll(compared.select("doc_id", "n_copies")).unionAll(bare)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows one. One shuffle on the text, after each task has
    dropped its own copies."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = docs.select(row).where(F.col("row.text").isNotNull())
    first = whole.groupBy(F.xxhash64("row.text"), "row.text").agg(F.min_by("row", F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"))).alias("row"))
    return first.select("row.*").unionByName(docs.where(F.col("text").isNull()))


@query(
    "x1_exact_copies",
    "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL",
)
def exact_copies(spark, sf_dir):
    return kept(table(spark, sf_dir, "documents"))
