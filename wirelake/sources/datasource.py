"""Spark data source ``pcap``: ``spark.read.format("pcap").load("/captures/*.pcap.gz")``.

One partition per file, and several per plain PCAP file. Frames are numbered from 1 in each file; the
column ``capture`` names the file, as joins over several captures need both. Local paths are read as
they are; ``s3a://``, ``gs://``, ``abfss://`` and other schemes go through pyarrow's file systems on the
executors. :func:`frames` wraps the source and adds other ways in.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wirelake.sources import container

SCHEMA = "frame_number bigint, timestamp timestamp_ntz, length bigint, original_length bigint, link_type int, raw_data binary, capture string"
_ARROW = pa.schema([("frame_number", pa.int64()), ("timestamp", pa.timestamp("us")), ("length", pa.int64()), ("original_length", pa.int64()), ("link_type", pa.int32()), ("raw_data", pa.binary()), ("capture", pa.string())])
#: Bytes of a plain capture file that one partition reads, and frames of one Arrow batch.
SPLIT_BYTES, BATCH = 64 * 1024 * 1024, 10_000


def is_remote(path: str) -> bool:
    """Whether a path is in an object store or another file system."""
    return "://" in path and not path.startswith("file://")


def _open(path: str) -> BinaryIO:
    if is_remote(path):
        from pyarrow import fs

        # the names that Hadoop uses are aliases here
        system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        return system.open_input_file(inner)
    return open(path.removeprefix("file://"), "rb")


def _paths(path: str) -> list[str]:
    out = []
    for part in (p.strip() for p in path.split(",")):
        if is_remote(part):
            out.append(part)
        else:
            part = part.removeprefix("file://")
            found = sorted(glob.glob(part)) if glob.has_magic(part) else [part]
            for f in found:
                out.extend(sorted(os.path.join(f, x) for x in os.listdir(f) if not x.startswith((".", "_"))) if os.path.isdir(f) else [f])
    return out


@dataclass
class Part(InputPartition):
    path: str
    offset: int
    first: int
    frames: int


class PcapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("the pcap source needs a path")
        self.paths = _paths(options["path"])
        if not self.paths:
            raise ValueError(f"no capture file at {options['path']}")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.legacy = options.get("legacytimes", options.get("legacyTimes", "false")).lower() == "true"

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            if not is_remote(path) and os.path.getsize(path) > self.split:
                with _open(path) as f:
                    out.extend(Part(path, *s) for s in container.splits(f, self.split))
            else:
                out.append(Part(path, 0, 1, -1))
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as raw:
            if partition.offset:
                head = raw.read(24)
                order, divide = container._PCAP[head[:4]]
                link = int.from_bytes(head[20:24], "little" if order == "<" else "big") & 0x0FFFFFFF
                raw.seek(partition.offset)
                source = container.pcap_records(raw, order, 1 if self.legacy else divide, link, partition.frames)
            else:
                source = container.records(container.opened(raw), self.legacy)
            rows, number = [], partition.first
            for us, wire, link, data in source:
                rows.append((number, us, len(data), wire, link, data, partition.path))
                number += 1
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class PcapSource(DataSource):
    """Options: ``path`` (file, directory, glob or list with commas), ``splitBytes``, ``legacyTimes``."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PcapReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format ``pcap`` known to a session."""
    # whether a format is known is looked up in the active session, wherever it is registered
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        spark.dataSource.register(PcapSource)
    except AnalysisException as e:
        if "DATA_SOURCE_ALREADY_EXISTS" not in str(e):
            raise
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())


def frames(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The frames of captures at a path, by the data source."""
    register(spark)
    return spark.read.format("pcap").options(**options).load(path)
