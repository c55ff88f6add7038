"""A keyed Parquet table in hash buckets, of which a write touches only its own.

Each write goes to a numbered folder that holds the touched buckets alone; a
manifest row for each of them, appended when the folder is complete, makes it
current. A job that dies half-way leaves the old buckets in place, and files of
other buckets stay as they are. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import tables
from vitrine.session import settle

BUCKET = "bucket"
BUCKETS = 256


class BucketedTable:
    """Same calls as ``VersionedTable``; the number of buckets is fixed at the first write."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id", buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.key = key
        self.buckets = buckets

    def _current(self) -> dict[int, int]:
        """Newest complete folder of every bucket; at most ``buckets`` entries."""
        try:
            held = self.spark.read.parquet(f"{self.root}/manifest")
        except AnalysisException:
            return {}
        rows = held.groupBy(BUCKET).agg(F.max("folder").alias("folder"), F.max("buckets").alias("buckets")).collect()
        for row in rows:
            if row["buckets"] != self.buckets:
                raise ValueError(f"{self.root} has {row['buckets']} buckets, not {self.buckets}")
        return {r[BUCKET]: r["folder"] for r in rows}

    def exists(self) -> bool:
        return bool(self._current())

    def _read(self, folders: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/data/folder={f}/{BUCKET}={b}" for b, f in sorted(folders.items())]
        read = self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", "true")
        return read.parquet(*paths).drop("folder", BUCKET)

    def read(self) -> DataFrame:
        return self._read(self._current())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> dict[int, int | None]:
        """Buckets of ``rows`` and their newest folder."""
        current = self._current()
        found = rows.select(self._bucket().alias(BUCKET)).distinct().collect()
        return {r[BUCKET]: current.get(r[BUCKET]) for r in found}

    def beside(self, rows: DataFrame) -> DataFrame | None:
        """The buckets that hold the keys of ``rows``, None where nothing is stored yet."""
        held = {b: f for b, f in self._touched(rows).items() if f is not None}
        return self._read(held) if held else None

    def _write(self, rows: DataFrame, touched: set[int]) -> int:
        folder = max(self._current().values(), default=-1) + 1
        placed = rows.withColumn(BUCKET, self._bucket())
        (
            placed.repartition(max(1, len(touched)), BUCKET)
            .write.mode("overwrite")
            .partitionBy(BUCKET)
            .parquet(f"{self.root}/data/folder={folder}")
        )
        listed = self.spark.createDataFrame(
            [(b, folder, self.buckets) for b in sorted(touched)], f"{BUCKET} int, folder int, buckets int"
        )
        listed.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return folder

    def upsert(
        self, rows: DataFrame, key: str | None = None, mode: str = "upsert", version: list[Column] | None = None
    ) -> int | None:
        """Write ``rows`` over the buckets they fall into; nothing happens without rows."""
        if key not in (None, self.key) or mode != "upsert":
            raise ValueError(f"a table bucketed by {self.key} takes upserts by it only")
        rows = settle(rows)
        touched = self._touched(rows)
        if not touched:
            return None
        held = {b: f for b, f in touched.items() if f is not None}
        fresh = tables.one_per_key(rows, self.key, version)
        if held:
            fresh = tables.upsert(self._read(held), fresh, self.key)
        return self._write(fresh, set(touched))

    def patch(self, patch: DataFrame, key: str | None = None, version: list[Column] | None = None) -> int | None:
        """Set columns of the ids that ``patch`` names, in their buckets alone."""
        if key not in (None, self.key):
            raise ValueError(f"a table bucketed by {self.key} takes patches by it only")
        patch = settle(patch)
        held = {b: f for b, f in self._touched(patch).items() if f is not None}
        if not held:
            return None
        return self._write(tables.patch_columns(self._read(held), patch, self.key, version), set(held))
