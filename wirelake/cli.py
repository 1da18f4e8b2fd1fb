"""Command line: ``python -m wirelake.cli capture.pcap -e "SELECT ..."``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from wirelake import engine, schema
from wirelake.functions.catalogue import PYTHON_FUNCTIONS, SQL_FUNCTIONS, register
from wirelake.plans.views import VIEWS
from wirelake.session import get_spark
from wirelake.sources.sinks import readable, text_table, write


def size(text: str) -> int:
    """Bytes of a size such as 64M; suffixes are powers of 1024."""
    text = text.strip().upper().removesuffix("B")
    factor = {"K": 1024, "M": 1024**2, "G": 1024**3}.get(text[-1:], 1)
    return int(float(text[:-1] if factor > 1 else text) * factor)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wirelake", description="SQL over packet captures")
    p.add_argument("file", nargs="?", help="capture, glob or URL")
    p.add_argument("-e", "--execute", help="run a query")
    p.add_argument("-f", "--sql-file", help="run the queries of a file")
    p.add_argument("--filter", help="tcpdump-style filter of frames")
    p.add_argument("--format", choices=("table", "csv", "json"), default="table")
    p.add_argument("-o", "--output", help="write the result to a path")
    p.add_argument("--export-format", choices=("parquet", "json", "csv", "sqlite"))
    p.add_argument("--list-protocols", action="store_true")
    p.add_argument("--list-udfs", action="store_true")
    p.add_argument("--schema", nargs="?", const="", metavar="TABLE")
    p.add_argument("--stats", action="store_true", help="rows by protocol")
    p.add_argument("--track-streams", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--keylog", help="TLS key log; else WIRELAKE_KEYLOG or SSLKEYLOGFILE names one")
    p.add_argument("--max-stream-memory", type=size, default=size("16M"), help="bytes kept of one direction of a connection")
    p.add_argument("--stream-timeout", type=int, default=300, help="idle seconds that end a connection")
    p.add_argument("--store", help="decode once into this folder and query that")
    p.add_argument("--batch-size", type=int, default=10_000)
    p.add_argument("--master", default=os.environ.get("SPARK_MASTER", "local[*]"))
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("--progress", action="store_true")
    # Spark streams, caches and maps files by itself and reads object stores by its own settings
    for name in ("--streaming", "--mmap", "--no-reader-eviction", "--cloud-anonymous"):
        p.add_argument(name, action="store_true", help=argparse.SUPPRESS)
    for name in ("--cache-size", "--cloud-endpoint", "--cloud-chunk-size"):
        p.add_argument(name, help=argparse.SUPPRESS)
    return p


def key_log_text(path: str | None) -> str:
    """Text of the key log that the option or the environment names; empty where it can't be read."""
    path = path or os.environ.get("WIRELAKE_KEYLOG") or os.environ.get("SSLKEYLOGFILE")
    if not path:
        return ""
    try:
        text = Path(path).read_text(errors="replace")
    except OSError as e:
        print(f"warning: key log {path} can't be read ({e}); nothing is decrypted", file=sys.stderr)
        return ""
    if not text.strip():
        print(f"warning: key log {path} is empty; nothing is decrypted", file=sys.stderr)
    return text


def shown(df: DataFrame, kind: str) -> str:
    if kind == "table":
        return text_table(df)
    rows = readable(df, text_only=True)
    if kind == "json":
        return "\n".join(rows.toJSON().toLocalIterator())
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(rows.columns)
    w.writerows(rows.toLocalIterator())
    return out.getvalue().rstrip("\n")


def statements(text: str) -> list[str]:
    """Statements that end with a semicolon outside of quotes."""
    out, now, quote = [], "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        if c == ";" and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [s for s in [*out, now.strip()] if s]


HELP = """SQL statements end with ;
.tables  .schema [table]  .protocols  .udfs  .stats  .timeinfo  .top column [n]  .histogram column
.hexdump frame  .export path query;  .cachestats  .help  .quit"""


def command(spark: SparkSession, line: str, opened: engine.Engine | None) -> str | None:
    """Answer to a line that begins with a dot; None ends the session."""
    word, *rest = line.split()
    if word in (".quit", ".exit", ".q"):
        return None
    if word in (".help", ".h"):
        return HELP
    if word == ".tables":
        return "\n".join([*schema.TABLES, *schema.STREAMS, *(v.name for v in VIEWS)])
    if word in (".schema", ".s"):
        return text_table(engine.protocol_schema(spark, rest[0] if rest else None), 5000)
    if word == ".protocols":
        return text_table(engine.protocols(spark))
    if word == ".udfs":
        return udfs()
    if word == ".stats":
        return text_table(engine.stats(spark))
    if word == ".timeinfo":
        return text_table(engine.time_info(spark))
    if word == ".top" and rest:
        return text_table(engine.top(spark, rest[0], int(rest[1]) if len(rest) > 1 else 10))
    if word == ".histogram" and rest:
        return text_table(engine.histogram(spark, rest[0]))
    if word == ".hexdump" and rest:
        return engine.hexdump(spark, int(rest[0]))
    if word == ".cachestats":
        if rest == ["reset"]:
            spark.catalog.clearCache()
        return text_table(engine.cache_stats(spark))
    if word == ".export" and len(rest) > 1 and opened:
        write(opened.sql(" ".join(rest[1:]).rstrip(";")), rest[0])
        return f"written to {rest[0]}"
    return f"unknown command {word}; .help lists them"


def udfs() -> str:
    return "\n".join([*(f"{f.name}({f.params}) -> {f.returns}: {f.about}" for f in SQL_FUNCTIONS), *PYTHON_FUNCTIONS])


def repl(spark: SparkSession, opened: engine.Engine, kind: str, condition: str | None) -> None:
    held = ""
    while True:
        try:
            line = input("wirelake> " if not held else "      -> ")
        except EOFError:
            return
        if not held and line.strip().startswith("."):
            answer = command(spark, line.strip(), opened)
            if answer is None:
                return
            print(answer)
            continue
        held += line + "\n"
        if line.rstrip().endswith(";"):
            for s in statements(held):
                try:
                    print(shown(opened.sql(s, condition), kind))
                except Exception as e:  # a wrong query must not end the session
                    print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
            held = ""


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    if a.list_udfs:
        print(udfs())
        return 0
    spark = get_spark(a.master, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(a.batch_size), "spark.ui.showConsoleProgress": str(a.progress).lower()})
    spark.sparkContext.setLogLevel("INFO" if a.verbose > 1 else "WARN" if a.verbose else "ERROR")
    if a.list_protocols or a.schema is not None:
        register(spark)
        print(text_table(engine.protocols(spark)) if a.list_protocols else text_table(engine.protocol_schema(spark, a.schema or None), 5000))
        return 0
    if not a.file:
        arguments().error("a capture is needed")
    opened = engine.Engine.open(spark, a.file, key_log_text(a.keylog), a.store, a.track_streams, idle_s=a.stream_timeout, stream_bytes=a.max_stream_memory)
    register(spark, shadow=True)
    texts = statements(a.execute) if a.execute else statements(Path(a.sql_file).read_text()) if a.sql_file else []
    if a.stats:
        print(text_table(engine.stats(spark)))
    for text in texts:
        df = opened.sql(text, a.filter)
        if a.output:
            write(df, a.output, a.export_format)
        else:
            print(shown(df, a.format))
    if not texts and not a.stats:
        repl(spark, opened, a.format, a.filter)
    return 0


if __name__ == "__main__":
    sys.exit(main())
