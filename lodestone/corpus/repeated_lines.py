"""X3: lines that many documents share.

Lines are what lies between newlines (\\n). A line with something but spaces in it that stands in more than `most` rows goes from all of them, and
the other lines of a text stay in their order; how often a line is repeated inside a row doesn't matter. Lines without
a character other than spaces stay. A text that loses all its lines is empty; null texts stay null. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query, table
from ..shared import written
from ..ship import ship

#: Rows that may share a line; parts over which the rows that hold one line are spread.
MOST, SALTS = 10, 64
#: Bytes of keys that are broadcast at most.
MOST_BYTES = 8_000_000


def _met(rows: DataFrame, few: DataFrame, on: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows whose key is among few, a written table that holds each key once. It is broadcast if its keys take at most most_bytes; else both
    sides are shuffled, and each key is there SALTS times, so that the rows of a hot one have as many tasks."""
    size = few.agg(F.count(F.lit(1)) * 32 + F.coalesce(F.sum(F.octet_length(F.col(on).cast("string"))), F.lit(0))).first()[0]
    if size <= most_bytes:
        return rows.join(F.broadcast(few.select(on)), on)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row", "place"), F.lit(SALTS)).cast("int"))
    return salted.join(few.select(on, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge"), [on, "salt"]).drop("salt")


def dropped(numbered: DataFrame, most: int = MOST) -> DataFrame:
    """row and places (from 0, in order) of the lines that go. numbered has row, unique, and text.

    Hashes of lines are counted first, so that only lines whose hash is in more than most rows are compared as texts."""
    lines = F.split("text", "\n")
    hashes = numbered.select(F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("h"))
    often = written(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("h"))
    placed = numbered.select("row", F.posexplode(lines).alias("place", "line")).withColumn("h", F.xxhash64("line")).where("line RLIKE '[^ \\t\\r]'")
    hits = written(_met(placed, often, "h").select("row", "place", "line"))
    shared = hits.select("row", "line").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return _met(hits, written(shared), "line").groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("places"))


def without_repeated_lines(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, text without the lines that go, n_lines (0 for null) and n_dropped."""
    ship(docs.sparkSession)
    numbered = written(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    both = numbered.join(dropped(numbered, most), "row", "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                counts.append((len(lines), len(places or ())))
                if places:
                    gone = set(places)
                    text = "\n".join(line for at, line in enumerate(lines) if at not in gone)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))], names=["doc_id", "text", "n_lines", "n_dropped"])

    return both.mapInArrow(run, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")


@query(
    "x3_repeated_lines",
    f"""
WITH numbered AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM numbered),
shared AS (SELECT line FROM lines WHERE regexp_matches(line, '[^ \\t\\r]') GROUP BY line HAVING count(DISTINCT row) > {MOST}),
parts AS (
  SELECT row, count(*) AS n_lines, count(*) FILTER (WHERE s.line IS NOT NULL) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY place) FILTER (WHERE s.line IS NULL), '') AS text
  FROM lines l LEFT JOIN shared s ON s.line = l.line GROUP BY row)
SELECT doc_id, parts.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM numbered LEFT JOIN parts USING (row)
""",
)
def repeated_lines(spark, sf_dir):
    return without_repeated_lines(table(spark, sf_dir, "documents"))
