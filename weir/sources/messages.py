"""Message logs: the options of Spark's Kafka source, and the same start and end modes over a log kept as a table.

A log table has topic, partition, offset, timestamp, key and value, as the Kafka source gives them. So a query is written once: over Kafka where its
connector is installed, over a table of messages elsewhere.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Log:
    """Which messages to read: topics by name or by pattern, and where to start and end.

    start is "earliest", "latest", "group" (after `committed`), "timestamp" (from start_millis on) or "offsets" (from those given, others from the
    earliest). end is "unbounded" or "latest". Offsets are by topic and partition.
    """

    topics: tuple[str, ...] = ()
    pattern: str | None = None
    start: str = "group"
    start_millis: int | None = None
    offsets: dict[str, dict[int, int]] = field(default_factory=dict)
    committed: dict[str, dict[int, int]] = field(default_factory=dict)
    reset: str = "earliest"
    end: str = "unbounded"

    def __post_init__(self):
        if bool(self.topics) == bool(self.pattern):
            raise ValueError("give topics or a pattern")
        if self.start not in ("earliest", "latest", "group", "timestamp", "offsets") or self.end not in ("unbounded", "latest") or self.reset not in ("earliest", "latest"):
            raise ValueError("unknown start, end or reset mode")
        if self.start == "timestamp" and self.start_millis is None:
            raise ValueError("start_millis is missing")

    def kafka_options(self, servers: str) -> dict[str, str]:
        """The options of spark.readStream or spark.read, format kafka."""
        out = {"kafka.bootstrap.servers": servers, **({"subscribePattern": self.pattern} if self.pattern else {"subscribe": ",".join(self.topics)})}
        if self.start == "timestamp":
            out |= {"startingTimestamp": str(self.start_millis), "startingOffsetsByTimestampStrategy": "latest"}
        elif self.start in ("offsets", "group") and (given := self.offsets if self.start == "offsets" else self.committed):
            out["startingOffsets"] = json.dumps({t: {str(p): o for p, o in ps.items()} for t, ps in given.items()})
        else:
            out["startingOffsets"] = self.reset if self.start in ("group", "offsets") else self.start
        return out | ({"endingOffsets": "latest"} if self.end == "latest" else {})

    def _topics(self) -> Column:
        return F.col("topic").rlike(f"^(?:{self.pattern})$") if self.pattern else F.col("topic").isin(*self.topics)

    def select(self, log: DataFrame) -> DataFrame:
        """The messages of a table that this reads, as a bounded read."""
        out = log.where(self._topics())
        if self.start == "latest" or self.start in ("group",) and not self.committed and self.reset == "latest":
            return out.limit(0)
        if self.start == "timestamp":
            # From the first offset whose message isn't older, in each partition: later offsets stay, whatever their times.
            first = out.where(F.col("timestamp") >= F.timestamp_millis(F.lit(self.start_millis))).groupBy("topic", "partition").agg(F.min("offset").alias("first"))
            # One row for each partition of the log.
            return out.join(F.broadcast(first), ["topic", "partition"]).where("offset >= first").select(*log.columns)
        given = self.offsets if self.start == "offsets" else self.committed if self.start == "group" else {}
        for topic, parts in given.items():
            for part, offset in parts.items():
                out = out.where(~((F.col("topic") == topic) & (F.col("partition") == part)) | (F.col("offset") >= offset))
        return out


def read(spark: SparkSession, log: Log, servers: str) -> DataFrame:
    """A stream of the log from Kafka, or a bounded read where its end is the latest offset; the connector must be installed."""
    reader = spark.read if log.end == "latest" else spark.readStream
    return reader.format("kafka").options(**log.kafka_options(servers)).load()


def stream_table(spark: SparkSession, path: str, log: Log, files_per_batch: int = 1) -> DataFrame:
    """A stream of the log from a folder of Parquet files of messages; modes that need offsets of the whole log, timestamp and latest, are for bounded reads."""
    if log.start in ("timestamp", "latest"):
        raise ValueError(f"a folder can't be streamed from {log.start}")
    schema = "topic string, partition int, offset long, timestamp timestamp, key binary, value binary"
    return log.select(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def watermarked(stream: DataFrame, time: str, delay: str = "0 seconds", millis: str | None = None) -> DataFrame:
    """The stream with a watermark of its time column, which comes from a column of epoch milliseconds where that is given."""
    if millis is not None:
        stream = stream.withColumn(time, F.timestamp_millis(F.col(millis)))
    return stream.withWatermark(time, delay)
