"""Protocol tables of a frames DataFrame.

:func:`table` decodes one protocol straight into its table. :func:`layers` decodes every protocol in one pass; stored as Parquet by protocol it is what
many tables over the same capture should read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import wirelake.decode.application
import wirelake.decode.link
import wirelake.decode.network
import wirelake.decode.tls  # noqa: F401
from wirelake import schema
from wirelake.decode import core
from wirelake.session import spread

def _rows(batches: Iterator[pa.RecordBatch], name: str, order: list[str]) -> Iterator[list[tuple]]:
    """Per batch the rows of a protocol, with the columns in the given order. Only decoders that may
    lead to the protocol run."""
    needed = core.leading_to(name)
    for batch in batches:
        out = []
        for number, link, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if data is None or link is None:
                continue
            for proto, depth, kind, ident, fields in core.layers(data, link, needed):
                if proto == name:
                    out.append((number, *(fields.get(c) for c in order), depth, kind, ident))
        yield out


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kind]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kind, strict=True)], schema=kind)


def table(frames: DataFrame, name: str, extended: bool = False, even: bool = False) -> DataFrame:
    """The table of one protocol. Frames with NULL data or link type give no rows; a frame may give
    several, one per occurrence; headers that are cut off give rows with NULL fields. ``extended`` adds
    the further fields that some protocols have; ``even`` says that the frames are spread already."""
    if name == "frames":
        return frames.select(*[F.col(c) for c, _ in schema.fields("frames")])
    arrow, order = schema.arrow_schema(name, extended), [c for c, _ in schema.own_fields(name, extended)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches, name, order):
            yield _batch(rows, arrow)

    needed = frames.select("frame_number", "link_type", "raw_data")
    return (needed if even else spread(needed)).mapInArrow(decode, schema.spark_schema(name, extended))


#: Arrays that a layer's fields are packed into by kind: name -> (kinds, Spark type, Arrow type).
_PACKS = {
    "i": (("u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64", "bool"), T.LongType(), pa.int64()), "d": (("f64",), T.DoubleType(), pa.float64()), "s": (("str",), T.StringType(), pa.string()),
    "b": (("bin",), T.BinaryType(), pa.binary()), "li": (("[u16]", "[u32]"), T.ArrayType(T.LongType()), pa.list_(pa.int64())), "ls": (("[str]",), T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "lb": (("[bin]",), T.ArrayType(T.BinaryType()), pa.list_(pa.binary())),
}


def _places(name: str) -> dict[str, list[str]]:
    """Columns of a protocol in the order they have in each array."""
    return {p: [c for c, k in schema.own_fields(name) if k in kinds] for p, (kinds, _, _) in _PACKS.items()}


def layers(frames: DataFrame) -> DataFrame:
    """Every layer of every frame: ``proto, frame_number, encap_depth, tunnel_type, tunnel_id`` and the
    fields of the protocol, packed into one array per kind of value so that a row is no wider than its
    protocol. Decoded once; write it partitioned by ``proto`` or persist it."""
    names = [n for n in schema.PROTOCOLS if n not in ("http", "http2")]
    places = {n: {p: tuple(cols) for p, cols in _places(n).items() if cols} for n in names}
    head = [("proto", T.StringType(), pa.string()), ("frame_number", T.LongType(), pa.int64()), ("encap_depth", T.ShortType(), pa.int16()), ("tunnel_type", T.StringType(), pa.string()), ("tunnel_id", T.LongType(), pa.int64())]
    spark_type = T.StructType([T.StructField(n, t) for n, t, _ in head] + [T.StructField(p, T.ArrayType(t)) for p, (_, t, _) in _PACKS.items()])
    arrow = pa.schema([(n, t) for n, _, t in head] + [(p, pa.list_(t)) for p, (_, _, t) in _PACKS.items()])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in arrow]
            for number, link, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None or link is None:
                    continue
                for name, depth, kind, ident, fields in core.layers(data, link):
                    for column, v in zip(columns, (name, number, depth, kind, ident), strict=False):
                        column.append(v)
                    own, get = places[name], fields.get
                    for column, p in zip(columns[5:], _PACKS, strict=True):
                        if p not in own:
                            column.append(None)
                        elif p == "i":
                            column.append([None if (v := get(c)) is None else int(v) for c in own[p]])
                        else:
                            column.append([get(c) for c in own[p]])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    return spread(frames.select("frame_number", "link_type", "raw_data")).mapInArrow(decode, spark_type)


def from_layers(decoded: DataFrame, name: str) -> DataFrame:
    """The table of one protocol out of :func:`layers`."""
    places = _places(name)
    at = {c: F.get(F.col(p), F.lit(i)) for p, cols in places.items() for i, c in enumerate(cols)}
    columns = [F.col(f.name) if f.name not in at else at[f.name].cast(f.dataType) for f in schema.spark_schema(name).fields]
    return decoded.where(F.col("proto") == name).select(*[c.alias(f.name) for c, f in zip(columns, schema.spark_schema(name).fields, strict=True)])
