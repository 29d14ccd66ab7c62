"""Tables kept in buckets, so that an update rewrites only the buckets it touches (A8-A14 on storage)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.operators.maintenance import insert_if_absent, upsert
from tradeweave.session import delete_folder, folder_names, rename_folder, write_table

BUCKET = "_bucket"


def replace_folder(rows: DataFrame, path: str) -> None:
    """Put rows in the place of the table at path: written beside it first, then swapped.

    If the job fails, the table at path is still the old one.  A crash between the two renames
    leaves the old table as ``<path>.old``, which the next call restores before it starts.
    """
    spark, new, old = rows.sparkSession, f"{path}.new", f"{path}.old"
    if folder_names(spark, path) is None and folder_names(spark, old) is not None:
        rename_folder(spark, old, path)
    rows.write.mode("overwrite").parquet(new)
    delete_folder(spark, old)
    if folder_names(spark, path) is not None:
        rename_folder(spark, path, old)
    rename_folder(spark, new, path)
    delete_folder(spark, old)


class StoredTable:
    """A table at a path, dealt to ``buckets`` folders by a hash of its key columns."""

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str], buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.key = [key] if isinstance(key, str) else list(key)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> StoredTable:
        self._write(rows, "error")
        return self

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets that hold any of ``keys`` by what ``make`` returns for their rows.

        The new rows are written to the shared folder first, so they do not depend on files that are
        being replaced; other buckets are neither read nor written.  Returns the touched buckets.
        """
        touched = sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())  # at most self.buckets numbers
        if not touched:
            return []
        whole = self.spark.read.parquet(self.path)
        made = write_table(make(whole.where(F.col(BUCKET).isin(touched)).drop(BUCKET)), "changed-buckets")
        self._write(made, "overwrite")
        filled = {r[0] for r in made.select(self.bucket()).distinct().collect()}
        for gone in set(touched) - filled:
            delete_folder(self.spark, f"{self.path}/{BUCKET}={gone}")
        return touched

    def upsert(self, updates: DataFrame, set_cols: Sequence[str]) -> list[int]:
        """Insert rows with a new key; for a known key replace the set columns only."""
        return self.change(updates, lambda rows: upsert(rows, updates, self.key, set_cols))

    def insert_if_absent(self, rows: DataFrame) -> list[int]:
        """Append rows with a new key (A10)."""
        return self.change(rows, lambda known: insert_if_absent(known, rows, self.key))

    def delete(self, keys: DataFrame) -> list[int]:
        """Remove the rows of the keys."""
        return self.change(keys, lambda rows: rows.join(keys.select(*self.key).distinct(), self.key, "left_anti").select(*rows.columns))
