"""Scans, sources and sinks: S1-S8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..registry import query, sql_query, table
from ..shared import shared_folder

sql_query("s1_scan", "SELECT * FROM {nation}", tables="nation")
sql_query("s2_pushdown", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity >= 45 AND l_returnflag = 'R'", tables="lineitem")


def round_trip(frame: DataFrame, form: str, **options: str) -> DataFrame:
    """Write a frame in a format and read it back with its schema."""
    path = shared_folder(frame.sparkSession)
    frame.write.format(form).options(**options).save(path)
    return frame.sparkSession.read.format(form).schema(frame.schema).options(**options).load(path)


for _form, _options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"}), ("xml", {"rowTag": "row"})):
    query(f"s3_{_form}" if _form != "xml" else "s4_xml", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(
        lambda spark, sf_dir, form=_form, options=_options: round_trip(table(spark, sf_dir, "supplier"), form, **options)
    )


@query("s3_text", "SELECT n_name AS value FROM nation")
def text(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "nation").selectExpr("n_name AS value"), "text")


@query("s6_binary", "SELECT true AS filled, true AS sized")
def binary(spark, sf_dir):
    return spark.read.format("binaryFile").load(f"{sf_dir}/nation.parquet").selectExpr("startswith(decode(left(content, 4), 'US-ASCII'), 'PAR1') AS filled", "length = octet_length(content) AS sized")


class RowGroups(DataSource):
    """A Python data source: the columns of Parquet files under a path that the schema names, read in Arrow batches. A part is a row group."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def reader(self, schema):
        return RowGroupReader(self.options["path"], schema.fieldNames())


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        import pyarrow.dataset as ds

        system, path = self._files()
        return [InputPartition((fragment.path, group.id)) for fragment in ds.dataset(path, filesystem=system, format="parquet").get_fragments() for group in fragment.row_groups]

    def read(self, partition):
        import pyarrow.parquet as pq

        path, group = partition.value
        with self._files()[0].open_input_file(path) as raw:
            yield from pq.ParquetFile(raw).read_row_group(group, columns=self.columns).to_batches()


@query("s7_python_source", "SELECT s_suppkey, s_acctbal FROM supplier")
def python_source(spark, sf_dir):
    from ..ship import ship

    ship(spark)
    spark.dataSource.register(RowGroups)
    return spark.read.format("row_groups").schema("s_suppkey bigint, s_acctbal double").load(f"{sf_dir}/supplier.parquet")
