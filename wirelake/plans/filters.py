"""tcpdump-style filters: text to a tree, the tree to SQL or to a condition on frames.

``host 10.0.0.1 and (tcp port 443 or net 192.168.0.0/16)``: words of any case, ``not`` before ``and``
before ``or``, with ``!``, ``&&`` and ``||`` for the same. Conditions name columns of the protocol tables.
"""

from __future__ import annotations

import ipaddress
import re
import threading
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: protocol word -> table; numbers of ports exist only in the first two
PROTOCOLS = {"tcp": "tcp", "udp": "udp", "icmp": "icmp", "icmp6": "icmpv6", "arp": "arp", "ip": "ipv4", "ip6": "ipv6"}
_TOKEN = re.compile(r"\s*(\(|\)|!|&&|\|\||[^\s()!&|]+)")


class FilterError(ValueError):
    """A filter text that does not follow the grammar."""


@dataclass(frozen=True)
class Primitive:
    """One condition. ``kind``: protocol, host, port, portrange, net or proto."""

    kind: str
    value: tuple = ()
    direction: str | None = None
    protocol: str | None = None


@dataclass(frozen=True)
class Not:
    inner: Primitive | Not | And | Or


@dataclass(frozen=True)
class And:
    left: Primitive | Not | And | Or
    right: Primitive | Not | And | Or


@dataclass(frozen=True)
class Or:
    left: Primitive | Not | And | Or
    right: Primitive | Not | And | Or


Tree = Primitive | Not | And | Or
_WORDS = {"&&": "and", "||": "or", "!": "not"}


class _Parser:
    def __init__(self, text: str) -> None:
        self.words: list[str] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FilterError(f"unexpected text at {text[at:]!r}")
            self.words.append(_WORDS.get(m.group(1), m.group(1)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at].lower() if self.at < len(self.words) else None

    def take(self, what: str) -> str:
        if self.at >= len(self.words):
            raise FilterError(f"{what} is missing at the end")
        self.at += 1
        return self.words[self.at - 1].lower()

    def either(self) -> Tree:
        left = self.both()
        while self.peek() == "or":
            self.at += 1
            left = Or(left, self.both())
        return left

    def both(self) -> Tree:
        left = self.negated()
        while self.peek() == "and":
            self.at += 1
            left = And(left, self.negated())
        return left

    def negated(self) -> Tree:
        if self.peek() == "not":
            self.at += 1
            return Not(self.negated())
        if self.peek() == "(":
            self.at += 1
            inner = self.either()
            if self.take("a closing parenthesis") != ")":
                raise FilterError("a closing parenthesis is missing")
            return inner
        return self.primitive()

    def primitive(self) -> Tree:
        word, direction, protocol = self.take("a condition"), None, None
        if word in ("src", "dst"):
            direction, word = word, self.take("a condition")
        if word in PROTOCOLS:
            if word in ("tcp", "udp") and self.peek() in ("port", "portrange", "src", "dst"):
                protocol, word = word, self.take("port")
                if word in ("src", "dst"):
                    direction, word = word, self.take("port")
            elif direction is None:
                return Primitive("protocol", (PROTOCOLS[word],))
            else:
                raise FilterError(f"{direction} {word} is no condition")
        if word == "host":
            return Primitive("host", (_address(self.take("an address")),), direction)
        if word == "port":
            return Primitive("port", (_number(self.take("a port"), 65535),), direction, protocol)
        if word == "portrange":
            low, dash, high = self.take("a range").partition("-")
            if not dash:
                raise FilterError("a port range is written a-b")
            return Primitive("portrange", (_number(low, 65535), _number(high, 65535)), direction, protocol)
        if word == "net":
            return Primitive("net", (_network(self.take("a network")),), direction)
        if word == "proto" and direction is None:
            return Primitive("proto", (_number(self.take("a protocol number"), 255),))
        raise FilterError(f"unknown condition {word!r}")


def _number(text: str, most: int) -> int:
    if not text.isascii() or not text.isdigit() or int(text) > most:
        raise FilterError(f"{text!r} is no number up to {most}")
    return int(text)


def _address(text: str) -> str:
    try:
        return str(ipaddress.ip_address(text))
    except ValueError as e:
        raise FilterError(f"{text!r} is no address") from e


def _network(text: str) -> str:
    address, slash, prefix = text.partition("/")
    if not slash:
        raise FilterError("a network needs a prefix length")
    address = _address(address)
    return f"{address}/{_number(prefix, 128 if ':' in address else 32)}"


def parse(text: str) -> Tree:
    """The tree of a filter."""
    if not text.strip():
        raise FilterError("the filter is empty")
    p = _Parser(text)
    tree = p.either()
    if p.at < len(p.words):
        raise FilterError(f"unexpected {p.words[p.at]!r}")
    return tree


def _sides(direction: str | None, condition: str) -> str:
    """The condition for one side, or for either."""
    sides = [direction] if direction else ["src", "dst"]
    parts = [condition.replace("{side}", s) for s in sides]
    return parts[0] if len(parts) == 1 else f"({' OR '.join(parts)})"


def _primitive(p: Primitive) -> str:
    if p.kind == "protocol":
        return f"{p.value[0]}.frame_number IS NOT NULL"
    if p.kind == "proto":
        return f"ipv4.protocol = {p.value[0]}"
    if p.kind in ("host", "net"):
        six = ":" in p.value[0]
        table = "ipv6" if six else "ipv4"
        if p.kind == "host":
            return _sides(p.direction, f"{table}.{{side}}_ip = {'ip6' if six else 'ip4'}('{p.value[0]}')")
        return _sides(p.direction, f"{'ip6_in_cidr' if six else 'ip_in_cidr'}({table}.{{side}}_ip, '{p.value[0]}')")
    test = f"= {p.value[0]}" if p.kind == "port" else f"BETWEEN {p.value[0]} AND {p.value[1]}"
    parts = [_sides(p.direction, f"{t}.{{side}}_port {test}") for t in ([p.protocol] if p.protocol else ["tcp", "udp"])]
    return parts[0] if len(parts) == 1 else f"({' OR '.join(parts)})"


def to_sql(tree: Tree) -> str:
    """The condition in SQL over the protocol tables."""
    if isinstance(tree, Primitive):
        return _primitive(tree)
    if isinstance(tree, Not):
        return f"NOT ({to_sql(tree.inner)})"
    return f"({to_sql(tree.left)}) {'AND' if isinstance(tree, And) else 'OR'} ({to_sql(tree.right)})"


def tables_of(tree: Tree) -> list[str]:
    """Tables that a filter reads."""
    return sorted(set(re.findall(r"\b(tcp|udp|icmp|icmpv6|arp|ipv4|ipv6)\.", to_sql(tree))))


def matching_frames(spark: SparkSession, text: str) -> DataFrame:
    """Numbers of the frames that a filter lets through, each once; a condition on a table that a
    frame has no row in is false, and so true under ``not``."""
    tree = parse(text)
    joins = "".join(f" LEFT JOIN {t} ON {t}.frame_number = f.frame_number" for t in tables_of(tree))
    return spark.sql(f"SELECT DISTINCT f.frame_number FROM frames f{joins} WHERE coalesce({_total(tree)}, false)")


def _total(tree: Tree) -> str:
    """:func:`to_sql` with two-valued conditions."""
    if isinstance(tree, Primitive):
        return f"coalesce({_primitive(tree)}, false)"
    if isinstance(tree, Not):
        return f"NOT ({_total(tree.inner)})"
    return f"({_total(tree.left)}) {'AND' if isinstance(tree, And) else 'OR'} ({_total(tree.right)})"


#: One query at a time has the names of the tables for itself.
_NAMES = threading.Lock()


def filtered(spark: SparkSession, sql: str, text: str, views: Iterable[str] = ()) -> DataFrame:
    """A query over only the frames that a filter lets through.

    The tables that the query names are cut to these frames first, so aggregates, limits and results
    without a ``frame_number`` follow the filter as well. ``views`` are views over the tables that begin
    at ``frames``; where the query names one of them, ``frames`` is cut. Tables without a
    ``frame_number``, such as those of connections, stay whole.
    """
    wanted = {w.lower() for w in re.findall(r"\w+", sql)}
    if wanted & {v.lower() for v in views}:
        wanted.add("frames")
    with _NAMES:
        frames = matching_frames(spark, text)
        own = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name.lower() in wanted}
        own = {n: df for n, df in own.items() if "frame_number" in df.columns and n not in views}
        try:
            for name, df in own.items():
                df.join(frames, "frame_number", "left_semi").select(df.columns).createOrReplaceTempView(name)
            # names are resolved here, once and for all
            return spark.sql(sql)
        finally:
            for name, df in own.items():
                df.createOrReplaceTempView(name)
