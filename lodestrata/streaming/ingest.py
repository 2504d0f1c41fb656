"""Incremental ingestion with Structured Streaming: merge by key, replace by source."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import graphstore as G
from lodestrata.session import staging


class GraphTable:
    """A table in versions: each write is a new folder, a pointer is switched last."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[str]:
        """Complete versions, oldest first; a version is complete once its marker exists."""
        if not self._fs.exists(self._p("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(""))]
        return sorted(n.removesuffix(".done") for n in names if n.endswith(".done"))

    def read(self) -> DataFrame:
        done = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{done[-1]}") if done else self.spark.createDataFrame([], self.schema)

    def written_at(self) -> int | None:
        """When the version that is read was completed, in milliseconds."""
        done = self.versions()
        return int(self._fs.getFileStatus(self._p(done[-1] + ".done")).getModificationTime()) if done else None

    def write(self, df: DataFrame) -> None:
        """Writes beside what is read, marks it complete, and drops versions but the last two."""
        done = self.versions()
        name = f"v{(int(done[-1][1:9]) + 1 if done else 0):08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        self._fs.create(self._p(name + ".done"), True).close()
        for old in done[:-1]:
            self._fs.delete(self._p(old + ".done"), False)
            self._fs.delete(self._p(old), True)


NODES = "id string, node_type string, label string, text string, path string, metadata string, ord bigint"
EDGES = "src string, dst string, edge_type string, weight double, metadata string, ord bigint"


def merge_nodes(target: GraphTable, batch: DataFrame, types: list[str] | None = None) -> None:
    """Rows of the paths in ``batch`` (of ``types``) go, those of ``batch`` come; the last version of an id counts."""
    kept = target.read()
    if types:
        paths = batch.select("path").where("path is not null").distinct().withColumn("_hit", F.lit(True))
        kept = kept.join(paths, "path", "left").where(~(F.coalesce("_hit", F.lit(False)) & F.col("node_type").isin(types))).select(G.NODE_COLUMNS)
    target.write(G.upsert_nodes(kept.select(G.NODE_COLUMNS).unionByName(batch.select(G.NODE_COLUMNS))))


def ingest_nodes(spark: SparkSession, folder: str, target: GraphTable, checkpoint: str, types: list[str] | None = None) -> None:
    """Merges the parquet files that have come into ``folder`` since the last call, then returns."""
    stream = spark.readStream.schema(NODES).parquet(folder)
    q = stream.writeStream.foreachBatch(lambda df, _: merge_nodes(target, df, types)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def replay(events: DataFrame, by: list[str], user: str, value: str, folder: str | None = None) -> DataFrame:
    """Aggregates a table that is read as a stream of files: ``n``, ``users``, ``total``.

    Each batch is aggregated into a table of its own number, written anew if the
    batch is tried again, so none counts twice. With a ``folder`` that is kept the
    job goes on after a restart where it was; without one it starts anew.
    """
    spark = events.sparkSession
    base = folder.rstrip("/") if folder else staging(spark, "replay")
    read = events.inputFiles()
    source, name = os.path.split(read[0])
    # a stream reads folders: a table of one file is picked out of its folder by name
    glob = "*.parquet" if source.endswith(".parquet") or len(read) > 1 else name
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", glob).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by, user).agg(F.count("*").alias("n"), F.sum(value).alias("total")).write.mode("overwrite").parquet(f"{base}/parts/batch={number}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.parquet(f"{base}/parts")
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.countDistinct(user).alias("users"), F.round(F.sum("total"), 4).alias("total"))
