"""Writing results: Parquet, JSON lines, CSV, SQLite and text tables."""

from __future__ import annotations

import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extension -> format; anything else is Parquet.
FORMATS = {"parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "csv": "csv", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite"}


def format_of(path: str) -> str:
    return FORMATS.get(Path(path).suffix.lstrip(".").lower(), "parquet")


def readable(df: DataFrame, text_only: bool = False) -> DataFrame:
    """Address columns as text: hardware addresses, IPv6 and, by name, IPv4 numbers.

    With ``text_only`` what a text format cannot hold (bytes, lists, maps) becomes text as well.
    """
    out = {}
    for f in df.schema.fields:
        c, low = F.col(f"`{f.name}`"), f.name.lower()
        if isinstance(f.dataType, T.BinaryType):
            short = F.lower(F.regexp_replace(F.to_char(c, F.lit("hex")), "(..)(?!$)", "$1:"))
            if "mac" in low or low in ("eth_src", "eth_dst", "chaddr", "hw_addr"):
                out[f.name] = short
            elif "ip" in low or low.startswith(("tunnel_src", "tunnel_dst", "outer_", "inner_")):
                out[f.name] = F.call_function("ip6_to_string", c)
            elif text_only:
                out[f.name] = F.lower(F.to_char(c, F.lit("hex")))
        elif isinstance(f.dataType, T.LongType) and (low in ("sender_ip", "target_ip", "ciaddr", "yiaddr", "siaddr", "giaddr", "gateway", "subnet_mask", "router", "server_id") or low.endswith(("_ip", "_ip_v4", "_ipv4")) or low.startswith(("src_ip", "dst_ip"))):
            out[f.name] = F.call_function("ip4_to_string", c)
        elif text_only and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out[f.name] = F.to_json(c)
    return df.withColumns(out) if out else df


def write(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Write ``df`` in the format of the extension or of ``kind``. All but SQLite are written by the
    executors, as a folder of parts."""
    kind = kind or format_of(path)
    if kind == "parquet":
        df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        readable(df, text_only=True).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "sqlite":
        sqlite(df, path)
    else:
        raise ValueError(f"unknown export format {kind}")


def sqlite(df: DataFrame, path: str, name: str = "data") -> int:
    """Stream ``df`` through the driver into one table of a SQLite file, replacing it; the number of
    rows. A file has one writer, so rows come partition by partition, never all at once."""
    kinds = []
    for f in df.schema.fields:
        t = f.dataType
        kinds.append("INTEGER" if isinstance(t, (T.IntegralType, T.BooleanType)) else "REAL" if isinstance(t, (T.FractionalType,)) else "BLOB" if isinstance(t, T.BinaryType) else "TEXT")
    iso = {f.name: F.date_format(F.col(f"`{f.name}`"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    iso |= {f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    iso |= {f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    rows = (df.withColumns(iso) if iso else df).toLocalIterator(prefetchPartitions=True)
    quoted = [f.name.replace('"', '""') for f in df.schema.fields]
    con, n = sqlite3.connect(path), 0
    try:
        with con:
            con.execute(f'DROP TABLE IF EXISTS "{name}"')
            con.execute(f'CREATE TABLE "{name}" (' + ", ".join(f'"{c}" {k}' for c, k in zip(quoted, kinds, strict=True)) + ")")
            insert = f'INSERT INTO "{name}" VALUES (' + ", ".join("?" * len(kinds)) + ")"
            chunk = []
            for row in rows:
                chunk.append(tuple(bytes(x) if isinstance(x, bytearray) else x for x in row))
                if len(chunk) == 5000:
                    con.executemany(insert, chunk)
                    n, chunk = n + len(chunk), []
            con.executemany(insert, chunk)
            n += len(chunk)
    finally:
        con.close()
    return n


def text_table(df: DataFrame, rows: int = 1000) -> str:
    """The first rows as an aligned table; a last line tells where there are more."""
    names, got = df.columns, readable(df, text_only=True).limit(rows + 1).collect()
    more, got = len(got) > rows, got[:rows]
    cells = [names] + [["NULL" if x is None else str(x) for x in r] for r in got]
    width = [max(len(r[i]) for r in cells) for i in range(len(names))]
    line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    body = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |" for r in cells]
    end = [f"only the first {rows} rows are shown; the other formats give all"] if more else []
    return "\n".join([line, body[0], line, *body[1:], line, *end])
