"""Table functions: captures and the catalogue inside SQL.

``SELECT * FROM read_pcap('a.pcap')`` and ``read_tcp('a.pcap')`` and so on read one file in one task, for looking
into files; many or large ones go through the data source.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from wirelake import schema
from wirelake.decode import core
from wirelake.sources import container, datasource

#: Protocols with a reader of their own: those that every link can carry and one frame holds whole.
READERS = tuple(n for n in schema.PROTOCOLS if n not in ("linux_sll", "netlink", "rtnetlink", "http", "http2"))


def _records(path: str) -> Iterator[container.Record]:
    with datasource._open(path) as raw:
        yield from container.records(container.opened(raw))


def _frames_function() -> Any:
    import datetime as dt

    class ReadPcap:
        @staticmethod
        def analyze(path: AnalyzeArgument, proto: AnalyzeArgument | None = None) -> AnalyzeResult:
            name = proto.value.lower() if proto is not None else "frames"
            return AnalyzeResult(T.StructType([f for f in schema.spark_schema(name).fields if f.name != "raw_data"]))

        def eval(self, path: str, proto: str = "frames") -> Iterator[tuple]:
            columns = [] if proto.lower() == "frames" else [c for c, _ in schema.own_fields(proto.lower())]
            for n, (us, wire, link, data) in enumerate(_records(path), 1):
                if not columns:
                    yield n, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us), len(data), wire, link
                    continue
                for name, depth, kind, ident, f in core.layers(data, link):
                    if name == proto.lower():
                        yield (n, *(f.get(c) for c in columns), depth, kind, ident)

    return F.udtf(ReadPcap)


def _protocol_function(name: str) -> Any:
    columns = [c for c, _ in schema.own_fields(name)]

    class ReadProtocol:
        def eval(self, path: str) -> Iterator[tuple]:
            for n, (_, _, link, data) in enumerate(_records(path), 1):
                for proto, depth, kind, ident, f in core.layers(data, link):
                    if proto == name:
                        yield (n, *(f.get(c) for c in columns), depth, kind, ident)

    return F.udtf(ReadProtocol, returnType=schema.spark_schema(name))


def register(spark: SparkSession) -> None:
    """``read_pcap(path)`` and ``read_pcap(path, protocol)``, ``read_<protocol>(path)``, ``pcap_protocols()`` and ``pcap_schema(table)``."""
    spark.udtf.register("read_pcap", _frames_function())
    for name in READERS:
        spark.udtf.register(f"read_{name}", _protocol_function(name))
    about = {d.name: d.about for d in core.loaded()} | {"http": "HTTP messages", "http2": "HTTP/2 frames"}
    rows = ", ".join(f"('{n}', '{about[n]}', {len(schema.own_fields(n))})" for n in schema.PROTOCOLS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pcap_protocols() RETURNS TABLE (name STRING, description STRING, field_count INT) RETURN SELECT * FROM VALUES {rows} AS t(name, description, field_count)")
    columns = ", ".join(f"('{n}', '{f.name}', '{f.dataType.simpleString()}', {str(f.nullable).lower()})" for n in (*schema.TABLES, *schema.STREAMS) for f in schema.spark_schema(n).fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pcap_schema(proto STRING) RETURNS TABLE (column_name STRING, column_type STRING, nullable BOOLEAN) RETURN SELECT c, t, n FROM VALUES {columns} AS v(p, c, t, n) WHERE p = proto")
