"""A point table in Parquet: create, upsert, scan, filter, count, reset.

Versions are directories below the table's path; `_current` names the live one,
so a failed write leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

POINT_SCHEMA = "id string, vector array<float>, text string, heading string, context string, source string, file_name string, tokens int, subtype string, path array<string>, heading_path array<string>, command_context string, chunk_index int, split_part int, type string"


class PointStore:
    """Vectors of one dimension with their payload."""

    def __init__(self, spark: SparkSession, path: str, dimension: int):
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension
        if self._current() is None:
            self.reset()
        held = self.read().select(F.size("vector").alias("n")).where(F.col("n") != dimension).head()
        if held:
            raise ValueError(f"the table holds vectors of {held.n} numbers, not {dimension}; reset it or take another path")

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        p, fs = self._file("_current")
        return self.spark.read.text(f"{self.path}/_current").head()[0] if fs.exists(p) else None

    def _publish(self, df: DataFrame) -> None:
        old, new = self._current(), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{new}")
        self.spark.createDataFrame([(new,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_current")
        if old:
            p, fs = self._file(old)
            fs.delete(p, True)

    def read(self) -> DataFrame:
        return self.spark.read.schema(POINT_SCHEMA).parquet(f"{self.path}/{self._current()}")

    def payloads(self, file_name: str | None = None) -> DataFrame:
        """All payload columns, without vectors; one file's only if asked."""
        df = self.read().drop("vector")
        return df.where(F.col("file_name") == file_name) if file_name is not None else df

    def upsert(self, points: DataFrame, order: str | None = None) -> None:
        """New points replace those of the same id; of several new ones the last by `order` wins. Vectors of another dimension are dropped."""
        new = points.where(F.size("vector") == self.dimension)
        rank = F.col(order) if order else F.lit(0)
        columns = [c.split(" ")[0] for c in POINT_SCHEMA.split(", ")]
        new = new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(dict(x.split(" ") for x in POINT_SCHEMA.split(", "))[c]).alias(c) for c in columns), F.lit(1).alias("_age"), rank.alias("_rank"))
        both = self.read().select(*columns, F.lit(0).alias("_age"), F.lit(None).cast(new.schema["_rank"].dataType).alias("_rank")).unionByName(new)
        w = Window.partitionBy("id").orderBy(F.desc("_age"), F.desc("_rank"), F.xxhash64("text"))
        self._publish(both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*columns))

    def reset(self) -> None:
        self._publish(self.spark.createDataFrame([], POINT_SCHEMA))

    def count(self) -> int:
        return self.read().count()
