"""A Parquet table kept as numbered full versions.

Each write goes to a folder of its own and becomes the current version when
Spark has put its success marker there, so a job that dies half-way leaves the
old version in place. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from vitrine.operators import tables


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self, version: int) -> str:
        return f"{self.root}/v={version:010d}"

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = []
        for entry in files.listStatus(path):
            name = entry.getPath().getName()
            marker = jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if name.startswith("v=") and files.exists(marker):
                found.append(int(name[2:]))
        return sorted(found)

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None) -> DataFrame:
        version = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(self._folder(version))

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Make ``df`` the current version and return its number."""
        held = self.versions()
        version = held[-1] + 1 if held else 0
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self._folder(version))
        return version

    def beside(self, rows: DataFrame) -> DataFrame | None:
        """What may hold the keys of ``rows``, None where nothing is stored yet."""
        return self.read() if self.exists() else None

    def upsert(
        self, rows: DataFrame, key: str = "id", mode: str = "upsert", version: list[Column] | None = None
    ) -> int | None:
        """Write ``rows`` over the current version; nothing happens without rows."""
        if rows.isEmpty():
            return None
        if not self.exists():
            return self.write(tables.one_per_key(rows, key, version))
        return self.write(tables.upsert(self.read(), rows, key, version, mode))

    def patch(self, patch: DataFrame, key: str = "id", version: list[Column] | None = None) -> int | None:
        if patch.isEmpty() or not self.exists():
            return None
        return self.write(tables.patch_columns(self.read(), patch, key, version))
