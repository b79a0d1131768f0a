"""Parquet sinks, of bounded tables and of streams, and the merge of a changelog into a table.

Everything goes through Spark's writers and Hadoop's file system, so any store that they reach will do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.streaming.changelog import ADDS

CODECS = ("uncompressed", "snappy", "gzip", "zstd")


@dataclass(frozen=True)
class ParquetSink:
    """Where and how to write.

    partition_by are folders by column value; rolling_rows closes a file after so many rows; times is the unit of timestamps, in UTC; success writes
    a _SUCCESS file to each folder of a partition that a commit has touched; compact puts a partition's rows of one write into one file for each task that has them all.
    """

    path: str
    partition_by: tuple[str, ...] = ()
    compression: str = "snappy"
    rolling_rows: int = 0
    times: str = "micros"
    success: bool = False
    compact: bool = False

    def __post_init__(self):
        if self.compression not in CODECS or self.times not in ("micros", "millis"):
            raise ValueError("unknown compression or unit of times")

    def _options(self) -> dict[str, str]:
        return {"compression": self.compression, "maxRecordsPerFile": str(self.rolling_rows)}

    def write(self, df: DataFrame, mode: str = "append") -> None:
        """Writes a bounded table; mode is append, overwrite, or overwrite_partitions for those that df has rows of."""
        spark = df.sparkSession
        if self.compact and self.partition_by:
            # Ranges of the partition's columns and a hash: a partition that holds most rows is still dealt to several tasks.
            df = df.repartitionByRange(*self.partition_by, F.xxhash64(*(c for c in df.columns if c not in self.partition_by)))
        touched = df.select(*self.partition_by).distinct() if self.success and self.partition_by else None
        writer = df.write.options(**self._options()).mode("append" if mode == "append" else "overwrite")
        if mode == "overwrite_partitions":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        with _timestamps(spark, self.times):
            (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(self.path)
        if touched is not None:
            self._commit(spark, touched)

    def _commit(self, spark: SparkSession, touched: DataFrame) -> None:
        """One _SUCCESS file for each touched folder: the driver gets a row for each partition of a table, as the writer's own commit does."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for row in touched.toLocalIterator():
            folder = "/".join(f"{c}={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(_text(row[c]))}" for c in self.partition_by)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{folder}/_SUCCESS")
            path.getFileSystem(conf).create(path, True).close()

    def stream(self, df: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Starts an append-only stream into the table, each batch once: a batch's rows replace what a failed try of it has left.

        Without partitions it is Spark's own file sink and its log. With partition commits each batch is one folder of its number, `batch=N`, overwritten on a retry.
        """
        trigger = trigger or {"availableNow": True}
        if not self.success:
            writer = df.writeStream.format("parquet").options(**self._options()).option("path", self.path).option("checkpointLocation", checkpoint)
            return (writer.partitionBy(*self.partition_by) if self.partition_by else writer).trigger(**trigger).start()

        def put(batch: DataFrame, number: int) -> None:
            batch = batch.withColumn("batch", F.lit(number))
            ParquetSink(self.path, (*self.partition_by, "batch"), self.compression, self.rolling_rows, self.times, True, self.compact).write(batch, "overwrite_partitions")

        return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _text(value) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else str(value)


class _timestamps:
    """Sets the unit of written timestamps for a block."""

    def __init__(self, spark: SparkSession, unit: str):
        self.conf, self.value = spark.conf, f"TIMESTAMP_{unit.upper()}"

    def __enter__(self):
        self.before = self.conf.get("spark.sql.parquet.outputTimestampType")
        self.conf.set("spark.sql.parquet.outputTimestampType", self.value)

    def __exit__(self, *_):
        self.conf.set("spark.sql.parquet.outputTimestampType", self.before)


def merged(table: DataFrame | None, changes: DataFrame, keys: list[str], order: str, kind: str = "row_kind") -> DataFrame:
    """A keyed table after changes: the last change of each key, by `order`, replaces its row or takes it away. -U rows don't matter, as their +U follows."""
    body = [c for c in changes.columns if c not in (kind, order)]
    last = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(F.col(kind).isin(*ADDS)))
    now = changes.where(F.col(kind) != "-U").withColumn("_rank", F.row_number().over(last)).where("_rank = 1")
    kept = now.where(F.col(kind).isin(*ADDS)).select(*body)
    if table is None:
        return kept
    return table.join(now.select(*keys), keys, "left_anti").select(*body).unionByName(kept)


class UpsertTable:
    """A keyed table in folders of versions, which a stream of changes is merged into batch by batch.

    A batch's version has its number, so a batch that runs again writes the same folder; readers take the latest version that is complete. The last `kept` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, kept: int = 2):
        self.spark, self.path, self.keys, self.order, self.kept = spark, path.rstrip("/"), keys, order, kept

    def _versions(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        found = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def merge(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        merged(self.read(number), batch, self.keys, self.order).write.mode("overwrite").parquet(f"{self.path}/v={number}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for old in self._versions()[: -self.kept]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}")
            path.getFileSystem(conf).delete(path, True)


def blackhole(df: DataFrame) -> None:
    """Computes every row of a bounded table and keeps none."""
    df.write.format("noop").mode("overwrite").save()
