"""A folder of named tables: what graphs are read from and written to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableStore:
    """Parquet tables in one folder, by name. With a single table its name may be left out."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def keys(self) -> list[str]:
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))

    def _key(self, key: str | None) -> str:
        if key is None:
            keys = self.keys()
            assert len(keys) == 1, f"name one of the tables: {keys}"
            return keys[0]
        return key

    def read(self, key: str | None = None, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
        """A table, of which only the columns asked for and the row groups that may match are read."""
        df = self.spark.read.parquet(f"{self.root}/{self._key(key)}")
        if where:
            df = df.where(where)
        return df.select(*columns) if columns is not None else df

    def read_range(self, column: str, low: object = None, high: object = None, key: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows with low <= column <= high; on a table sorted by the column few row groups are touched."""
        df = self.spark.read.parquet(f"{self.root}/{self._key(key)}")
        if low is not None:
            df = df.where(F.col(column) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(column) <= F.lit(high))
        return df.select(*columns) if columns is not None else df

    def write(self, key: str, df: DataFrame, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
        writer = df.write.mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{key}")

    def append(self, key: str, df: DataFrame) -> None:
        self.write(key, df, "append")

    def write_sorted(self, key: str, df: DataFrame, by: Sequence[str], partitions: int | None = None) -> None:
        """Write in the global order of ``by``: a range-partitioned external sort, so that range reads prune row groups."""
        ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
        self.write(key, ranged.sortWithinPartitions(*by))

    def write_bucketed(self, name: str, df: DataFrame, by: str, buckets: int) -> None:
        """A catalog table bucketed by a key, so that joins on the key need no shuffle."""
        df.write.bucketBy(buckets, by).sortBy(by).mode("overwrite").saveAsTable(name)
