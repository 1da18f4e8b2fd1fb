"""Opening captures: tables, views and functions in a session, ready for SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake import schema
from wirelake.decode import core, tables
from wirelake.functions import catalogue, table_functions
from wirelake.plans import filters, views
from wirelake.session import spread
from wirelake.sources import datasource
from wirelake.sources.datasource import frames as read_frames
from wirelake.streaming import analysis


@dataclass
class Engine:
    """An open capture. Tables and views are temporary views of the session."""

    spark: SparkSession
    frames: DataFrame
    found: DataFrame | None = None
    kept: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, key_log: str = "", store: str | None = None, streams: bool = True, cache: bool = True, idle_s: int = 300, stream_bytes: int = analysis.MOST_BYTES, capture_time: bool = True, **options: str) -> Engine:
        """Open the captures at a path, glob or list.

        Frames are decoded once, at the first query, and the layers kept in memory and on disk; without
        ``cache`` every table decodes what it needs when it is read. With ``store``, frames and layers are
        written there as Parquet partitioned by protocol, and the tables read that: the way to go for large
        captures, and for those that are queried more than once. ``streams`` adds the tables of TCP streams, and
        ``key_log`` (the text of one) what can be decrypted with it. Numbers of frames are unique in a
        capture; of several captures every one but the first goes on where the one before ended.
        """
        frames = _one_numbering(read_frames(spark, path, **options), path)
        kept = even = None
        if store:
            frames.write.mode("overwrite").parquet(f"{store}/frames")
            frames = spark.read.parquet(f"{store}/frames")
            tables.layers(frames).write.mode("overwrite").partitionBy("proto").parquet(f"{store}/layers")
            decoded = spark.read.parquet(f"{store}/layers")
            made = {n: tables.from_layers(decoded, n) for n in schema.PROTOCOLS if n not in ("http", "http2")}
        elif cache:
            kept = tables.layers(frames).persist(StorageLevel.MEMORY_AND_DISK)
            made = {n: tables.from_layers(kept, n) for n in schema.PROTOCOLS if n not in ("http", "http2")}
        else:
            even = spread(frames.select("frame_number", "link_type", "raw_data"))  # once, as it plans the reading of the captures
            made = {n: tables.table(even, n, even=True) for n in schema.PROTOCOLS if n not in ("http", "http2")}
        made["frames"] = tables.table(frames, "frames")
        engine = cls(spark, frames, kept=kept)
        if streams:
            engine.found = analysis.analysed(frames, key_log, idle_s * 1_000_000, stream_bytes).persist(StorageLevel.MEMORY_AND_DISK)
            ids = analysis.numbered(engine.found)
            made |= {n: analysis.stream_table(engine.found, ids, n) for n in analysis.KINDS}
        else:
            made |= {n: spark.createDataFrame([], schema.spark_schema(n)) for n in ("http", "http2")}
        made |= {f"{n}_extended": tables.table(frames if even is None else even, n, extended=True, even=even is not None) for n in schema.EXTENDED}
        for name, df in made.items():
            df.createOrReplaceTempView(name)
        catalogue.register(spark)
        if capture_time:
            us = F.unix_micros(F.col("timestamp").cast("timestamp"))
            catalogue.register_capture_time(spark, *frames.agg(F.min(us), F.max(us)).first())
        views.register(spark)
        table_functions.register(spark)
        return engine

    def sql(self, text: str, filter: str | None = None) -> DataFrame:
        """A query, over only the frames of a tcpdump-style filter where one is given."""
        return filters.filtered(self.spark, text, filter, [v.name for v in views.VIEWS]) if filter else self.spark.sql(text)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def close(self) -> None:
        for df in (self.found, self.kept):
            if df is not None:
                df.unpersist()


def _one_numbering(frames: DataFrame, path: str) -> DataFrame:
    """Frames of several captures under one numbering. One capture is left as it is."""
    spark = frames.sparkSession
    if len(datasource._paths(path)) < 2:
        return frames
    # one row per file; counting reads the files once more
    sizes = frames.groupBy("capture").agg(F.max("frame_number").alias("n")).orderBy("capture").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["capture"], total))
        total += r["n"]
    shift = spark.createDataFrame(before, "capture string, __before bigint")
    return frames.join(F.broadcast(shift), "capture").withColumn("frame_number", F.col("frame_number") + F.col("__before")).select(frames.columns)


def protocols(spark: SparkSession) -> DataFrame:
    """``name, description, field_count`` of every protocol."""
    about = {d.name: d.about for d in core.loaded()} | {"http": "HTTP messages", "http2": "HTTP/2 frames"}
    return spark.createDataFrame([(n, about[n], len(schema.own_fields(n))) for n in schema.PROTOCOLS], "name string, description string, field_count int")


def protocol_schema(spark: SparkSession, name: str | None = None) -> DataFrame:
    """``table_name, column_name, column_type, nullable`` of one table or all."""
    names = [name] if name else [*schema.TABLES, *schema.STREAMS]
    return spark.createDataFrame([(n, f.name, f.dataType.simpleString(), f.nullable) for n in names for f in schema.spark_schema(n).fields], "table_name string, column_name string, column_type string, nullable boolean")


def cache_stats(spark: SparkSession) -> DataFrame:
    """What the session's storage holds, in the columns of a parse cache. Spark evicts and recomputes by
    itself, so hits and evictions are not counted."""
    infos = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    entries = sum(i.numCachedPartitions() for i in infos)
    most = sum(i.numPartitions() for i in infos)
    memory = sum(i.memSize() for i in infos)
    return spark.createDataFrame(
        [(0, 0, 0.0, entries, most, entries / most if most else 0.0, 0, 0, 0, entries, len(infos), memory)],
        "hits bigint, misses bigint, hit_ratio double, entries bigint, max_entries bigint, utilization double, evictions_lru bigint, evictions_reader bigint, evictions_total bigint, peak_entries bigint, active_readers bigint, memory_bytes bigint",
    )


def read_pcap(spark: SparkSession, path: str, protocol: str = "frames", **options: str) -> DataFrame:
    """One table of captures without opening an engine; ``frames`` comes without its bytes."""
    frames = _one_numbering(read_frames(spark, path, **options), path)
    return frames.drop("raw_data", "capture") if protocol == "frames" else tables.table(frames, protocol)


def stats(spark: SparkSession) -> DataFrame:
    """Rows by protocol, the most first."""
    parts = " UNION ALL ".join(f"SELECT '{t}' AS protocol, count(*) AS cnt FROM {t}" for t in ("tcp", "udp", "icmp", "dns", "http", "tls"))
    return spark.sql(f"SELECT * FROM ({parts}) ORDER BY cnt DESC, protocol")


def time_info(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS frames FROM frames")


def top(spark: SparkSession, column: str, n: int = 10) -> DataFrame:
    """The most frequent values of a column of the first common table that has it."""
    for t in ("frames", "ipv4", "tcp", "udp", "dns", *schema.PROTOCOLS):
        if column in spark.table(t).columns:
            return spark.table(t).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)
    raise ValueError(f"no table has a column {column}")


def histogram(spark: SparkSession, column: str) -> DataFrame:
    """Counts of a numeric column in ten ranges of equal width, at least 1 wide."""
    for t in ("frames", "ipv4", "tcp", "udp", "dns", *schema.PROTOCOLS):
        if column in spark.table(t).columns:
            v = F.col(column).cast("double")
            low, high = spark.table(t).agg(F.min(v), F.max(v)).first()
            width = max(((high or 0) - (low or 0)) / 10, 1)
            return spark.table(t).where(v.isNotNull()).groupBy((F.floor(v / width) * width).alias("bucket")).agg(F.count("*").alias("count")).orderBy("bucket")
    raise ValueError(f"no table has a column {column}")


def hexdump(spark: SparkSession, number: int) -> str:
    """The bytes of a frame, sixteen a line."""
    row = spark.table("frames").where(F.col("frame_number") == number).select("raw_data").first()
    if row is None:
        return f"no frame {number}"
    data, lines = bytes(row[0]), []
    for at in range(0, len(data), 16):
        part = data[at : at + 16]
        lines.append(f"{at:08x}  {part.hex(' '):<47}  {''.join(chr(b) if 32 <= b < 127 else '.' for b in part)}")
    return "\n".join(lines)
