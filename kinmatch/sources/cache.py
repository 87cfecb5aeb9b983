"""A cache of tables: Parquet folders that are complete or absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class TableCache:
    """Named tables below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, name: str, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def load(self, name: str) -> DataFrame | None:
        """The table, or None if it was never saved whole."""
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The saved table, made and saved first if it's missing."""
        if (found := self.load(name)) is None:
            self.save(name, make())
            found = self.load(name)
        return found

    def missing(self, names: list[str]) -> list[str]:
        """The names that can't be loaded."""
        return [n for n in names if self.load(n) is None]
