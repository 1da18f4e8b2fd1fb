"""The SQL functions of the engine: address, protocol, time and histogram functions.

Nearly all are SQL expressions, which the analyzer inlines, so they stay inside whole-stage code
generation and constant arguments fold. Only IPv6 text and free time formats need Python, which gets
Arrow batches.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions import names

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
_QUAD = rf"({_OCTET}[.]){{3}}{_OCTET}"


@dataclass(frozen=True)
class Function:
    """A function in SQL: parameters with types, the type of the result, and its expression."""

    name: str
    params: str
    returns: str
    body: str
    about: str

    def ddl(self) -> str:
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({self.params}) RETURNS {self.returns} COMMENT '{self.about}' RETURN {self.body}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _lookup(n: str, table: dict[int, str], default: str) -> str:
    """``CASE`` over a table; NULL gives NULL, other codes the default expression."""
    cases = " ".join(f"WHEN {k} THEN {_text(v)}" for k, v in table.items())
    return f"CASE WHEN {n} IS NULL THEN NULL ELSE CASE {n} {cases} ELSE {default} END END"


def _nested(table: dict[int, tuple[dict[int, str], str]], fixed: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {t} THEN " + _lookup("c", codes, f"concat({_text(other + ' (code ')}, c, ')')") for t, (codes, other) in table.items())
    cases += "".join(f" WHEN {t} THEN {_text(v)}" for t, v in fixed.items())
    return f"CASE WHEN t IS NULL OR c IS NULL THEN NULL ELSE CASE t {cases} ELSE CASE WHEN c = 0 THEN 'No Code' ELSE concat('Code ', c) END END END"


def _address(text: str) -> str:
    """Number of a dotted quad that has been checked."""
    return " + ".join(f"try_cast(split_part({text}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))


def _unknown(n: str) -> str:
    return f"concat('Unknown (', {n}, ')')"


# hex and unhex may be shadowed in a session, to_char and to_binary are not
_NET = "split_part(cidr, '/', 1)"
_PREFIX = "try_cast(split_part(cidr, '/', 2) AS INT)"
_MAC_BARE = "lower(regexp_replace(m, '[:-]', ''))"
_FIRST = "cast(conv(to_char(substring(m, 1, 1), 'hex'), 16, 10) AS INT)"
_ENTRIES = "array_sort(map_entries(h))"
_TOTAL = "aggregate(map_values(h), 0L, (a, x) -> a + x)"
# a bucket is named by its low edge; its width follows from it
_SHIFT = "greatest(length(bin({0})) - 8, 0)"
_MEDIAN = "({0}.key + CASE WHEN {0}.key < 256 THEN 0L ELSE shiftleft(1L, length(bin({0}.key)) - 9) END)"
_HIGH = "({0} + CASE WHEN {0} < 256 THEN 0L ELSE shiftleft(1L, length(bin({0})) - 8) - 1 END)"

SQL_FUNCTIONS = (
    Function("ip4", "s STRING", "BIGINT", f"CASE WHEN s RLIKE '^{_QUAD}$' THEN {_address('s')} END", "Number of a dotted quad, NULL where it is none"),
    Function("ip4_to_string", "x BIGINT", "STRING", "concat(shiftright(x, 24) & 255, '.', shiftright(x, 16) & 255, '.', shiftright(x, 8) & 255, '.', x & 255)", "Dotted quad of a number"),
    Function("ip_in_cidr", "x BIGINT, cidr STRING", "BOOLEAN", f"CASE WHEN x IS NULL THEN NULL WHEN cidr RLIKE '^{_QUAD}/[0-9]{{1,2}}$' AND {_PREFIX} <= 32 THEN shiftright(x, 32 - {_PREFIX}) = shiftright({_address(_NET)}, 32 - {_PREFIX}) END", "Whether an address lies in a network, NULL for a bad network"),
    Function("is_private_ip", "x BIGINT", "BOOLEAN", "x BETWEEN 167772160 AND 184549375 OR x BETWEEN 2886729728 AND 2887778303 OR x BETWEEN 3232235520 AND 3232301055", "10/8, 172.16/12 and 192.168/16"),
    Function("is_multicast_ip", "x BIGINT", "BOOLEAN", "shiftright(x, 28) = 14", "224/4"),
    Function("is_loopback_ip", "x BIGINT", "BOOLEAN", "shiftright(x, 24) = 127", "127/8"),
    Function("is_link_local_ip6", "b BINARY", "BOOLEAN", "CASE WHEN length(b) = 16 THEN to_char(substring(b, 1, 1), 'hex') = 'FE' AND (cast(conv(to_char(substring(b, 2, 1), 'hex'), 16, 10) AS INT) & 192) = 128 END", "fe80::/10"),
    Function("is_multicast_ip6", "b BINARY", "BOOLEAN", "CASE WHEN length(b) = 16 THEN to_char(substring(b, 1, 1), 'hex') = 'FF' END", "ff00::/8"),
    Function("mac", "m STRING", "BINARY", (
        f"CASE WHEN m RLIKE '^[0-9A-Fa-f]{{12}}$' THEN to_binary(m, 'hex') WHEN m RLIKE '^[0-9A-Fa-f]{{1,2}}(:[0-9A-Fa-f]{{1,2}}){{5}}$' OR m RLIKE '^[0-9A-Fa-f]{{1,2}}(-[0-9A-Fa-f]{{1,2}}){{5}}$' "
        "THEN to_binary(array_join(transform(split(m, '[:-]'), p -> lpad(p, 2, '0')), ''), 'hex') END"
    ), "Bytes of a hardware address with colons, dashes or neither"),
    Function("mac_to_string", "m BINARY", "STRING", "CASE WHEN length(m) = 6 THEN lower(regexp_replace(to_char(m, 'hex'), '(..)(?!$)', '$1:')) END", "Hardware address with colons"),
    Function("mac_is_broadcast", "m BINARY", "BOOLEAN", "CASE WHEN length(m) = 6 THEN to_char(m, 'hex') = 'FFFFFFFFFFFF' END", "All bits set"),
    Function("mac_is_multicast", "m BINARY", "BOOLEAN", f"CASE WHEN length(m) = 6 THEN ({_FIRST} & 1) = 1 END", "Group bit"),
    Function("mac_is_local", "m BINARY", "BOOLEAN", f"CASE WHEN length(m) = 6 THEN ({_FIRST} & 2) = 2 END", "Locally administered bit"),
    Function("tcp_flags_str", "f INT", "STRING", "CASE WHEN f IS NOT NULL THEN concat_ws(',', " + ", ".join(f"CASE WHEN (f & {1 << i}) <> 0 THEN '{n}' END" for i, n in enumerate(names.TCP_FLAGS)) + ") END", "Names of the set flags"),
    Function("has_tcp_flag", "f INT, flag STRING", "BOOLEAN", "CASE WHEN f IS NULL OR flag IS NULL THEN NULL ELSE CASE upper(flag) " + " ".join(f"WHEN '{n}' THEN (f & {1 << i}) <> 0" for i, n in enumerate(names.TCP_FLAGS)) + " ELSE false END END", "Whether a flag is set; false for unknown names"),
    Function("dns_type_name", "n INT", "STRING", _lookup("n", names.DNS_TYPE, "concat('TYPE', n)"), "DNS record type"),
    Function("dns_rcode_name", "n INT", "STRING", _lookup("n", names.DNS_RCODE, "concat('RCODE', n)"), "DNS response code"),
    Function("dns_class_name", "n INT", "STRING", _lookup("n", names.DNS_CLASS, "concat('CLASS', n)"), "DNS class"),
    Function("icmp_type_name", "n INT", "STRING", _lookup("n", names.ICMP_TYPE, "concat('Type ', n)"), "ICMP type"),
    Function("icmpv6_type_name", "n INT", "STRING", _lookup("n", names.ICMPV6_TYPE, "concat('Type ', n)"), "ICMPv6 type"),
    Function("icmp_code_name", "t INT, c INT", "STRING", _nested(names.ICMP_CODE, {}), "ICMP code of a type"),
    Function("icmpv6_code_name", "t INT, c INT", "STRING", _nested(names.ICMPV6_CODE, {2: "Packet Too Big"}), "ICMPv6 code of a type"),
    Function("ip_proto_name", "n INT", "STRING", _lookup("n", names.IP_PROTO, "concat('Proto ', n)"), "IP protocol"),
    Function("ethertype_name", "n INT", "STRING", _lookup("n", names.ETHERTYPE, "concat('0x', lpad(conv(cast(n AS STRING), 10, 16), greatest(4, length(conv(cast(n AS STRING), 10, 16))), '0'))"), "EtherType"),
    Function("bgp_message_type_name", "n INT", "STRING", _lookup("n", names.BGP_MESSAGE, _unknown("n")), "BGP message type"),
    Function("bgp_origin_name", "n INT", "STRING", _lookup("n", names.BGP_ORIGIN, _unknown("n")), "BGP origin"),
    Function("ospf_packet_type_name", "n INT", "STRING", _lookup("n", names.OSPF_PACKET, _unknown("n")), "OSPF packet type"),
    Function("ospf_lsa_type_name", "n INT", "STRING", _lookup("n", names.OSPF_LSA, _unknown("n")), "OSPF link state type"),
    Function("gtp_message_type_name", "n INT", "STRING", _lookup("n", names.GTP_MESSAGE, _unknown("n")), "GTP message type of versions 1 and 2"),
    Function("ntp_mode_name", "n INT", "STRING", _lookup("n", names.NTP_MODE, _unknown("n")), "NTP mode"),
    Function("ntp_stratum_name", "n INT", "STRING", _lookup("n", names.NTP_STRATUM, "CASE WHEN n BETWEEN 2 AND 15 THEN concat('Secondary (stratum ', n, ')') ELSE concat('Reserved (', n, ')') END"), "NTP stratum"),
    Function("tls_version_name", "n INT", "STRING", _lookup("n", names.TLS_VERSION, "CASE WHEN (n & 3855) = 2570 THEN 'GREASE' ELSE concat('Unknown (0x', lower(lpad(conv(cast(n AS STRING), 10, 16), greatest(4, length(conv(cast(n AS STRING), 10, 16))), '0')), ')') END"), "TLS version"),
    Function("tls_record_type_name", "n INT", "STRING", _lookup("n", names.TLS_RECORD, _unknown("n")), "TLS record type"),
    Function("pcap_hex", "b BINARY", "STRING", "lower(to_char(b, 'hex'))", "Lower-case hexadecimal digits"),
    Function("pcap_unhex", "s STRING", "BINARY", "CASE WHEN regexp_replace(trim(s), '^0[xX]', '') RLIKE '^([0-9A-Fa-f]{2})*$' THEN to_binary(regexp_replace(trim(s), '^0[xX]', ''), 'hex') END", "Bytes of hexadecimal digits with or without 0x"),
    Function("datetime", "ts TIMESTAMP_NTZ", "STRING", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "ISO text with microseconds"),
    Function("fmt_date", "ts TIMESTAMP_NTZ", "STRING", "date_format(ts, 'yyyy-MM-dd')", "Date as text"),
    Function("fmt_time", "ts TIMESTAMP_NTZ", "STRING", "date_format(ts, 'HH:mm:ss.SSSSSS')", "Time of day as text"),
    Function("epoch", "ts TIMESTAMP_NTZ", "DOUBLE", "unix_micros(cast(ts AS TIMESTAMP)) / 1e6D", "Seconds since 1970"),
    Function("epoch_ms", "ts TIMESTAMP_NTZ", "BIGINT", "unix_micros(cast(ts AS TIMESTAMP)) div 1000", "Milliseconds since 1970, towards zero"),
    Function("format_ip4", "x BIGINT", "STRING", "ip4_to_string(x)", "Dotted quad of a number"),
    Function("format_mac", "m BINARY", "STRING", "mac_to_string(m)", "Hardware address with colons"),
    Function("format_ip4_list", "xs ARRAY<BIGINT>", "ARRAY<STRING>", "transform(xs, x -> concat(shiftright(x, 24) & 255, '.', shiftright(x, 16) & 255, '.', shiftright(x, 8) & 255, '.', x & 255))", "Dotted quads of numbers"),
    Function("format_mac_list", "ms ARRAY<BINARY>", "ARRAY<STRING>", "transform(ms, m -> lower(regexp_replace(to_char(m, 'hex'), '(..)(?!$)', '$1:')))", "Hardware addresses with colons"),
    Function("hdr_bucket", "v BIGINT", "BIGINT", f"CASE WHEN v >= 0 THEN shiftleft(shiftright(v, {_SHIFT.format('v')}), {_SHIFT.format('v')}) END", "Low edge of the histogram bucket of a value"),
    Function("hdr_bucket_high", "low BIGINT", "BIGINT", _HIGH.format("low"), "High edge of the bucket with that low edge"),
    Function("hdr_count", "h MAP<BIGINT, BIGINT>", "BIGINT", _TOTAL, "Values in a histogram"),
    Function("hdr_min", "h MAP<BIGINT, BIGINT>", "BIGINT", "CASE WHEN h IS NOT NULL THEN coalesce(array_min(map_keys(h)), 0L) END", "Low edge of the lowest bucket"),
    Function("hdr_max", "h MAP<BIGINT, BIGINT>", "BIGINT", f"CASE WHEN h IS NOT NULL THEN coalesce({_HIGH.format('array_max(map_keys(h))')}, 0L) END", "High edge of the highest bucket"),
    Function("hdr_mean", "h MAP<BIGINT, BIGINT>", "DOUBLE", f"CASE WHEN {_TOTAL} > 0 THEN aggregate(map_entries(h), 0D, (a, e) -> a + cast(e.value AS DOUBLE) * {_MEDIAN.format('e')}) / {_TOTAL} WHEN h IS NOT NULL THEN 0D END", "Mean over bucket medians"),
    Function("hdr_stdev", "h MAP<BIGINT, BIGINT>", "DOUBLE", (
        f"CASE WHEN {_TOTAL} > 0 THEN sqrt(aggregate(map_entries(h), 0D, (a, e) -> a + e.value * pow({_MEDIAN.format('e')} - hdr_mean(h), 2)) / {_TOTAL}) WHEN h IS NOT NULL THEN 0D END"
    ), "Population standard deviation over bucket medians"),
    Function("hdr_percentile", "h MAP<BIGINT, BIGINT>, p DOUBLE", "DOUBLE", (
        f"CASE WHEN h IS NULL OR p IS NULL THEN NULL WHEN size(h) = 0 THEN 0D WHEN p <= 0 THEN cast(hdr_min(h) AS DOUBLE) ELSE cast(aggregate({_ENTRIES}, struct(0L AS seen, cast(NULL AS BIGINT) AS found), "
        f"(a, e) -> struct(a.seen + e.value AS seen, CASE WHEN a.found IS NULL AND a.seen + e.value >= greatest(1L, cast(ceil(least(CASE WHEN p > 1 THEN p / 100 ELSE p END, 1D) * {_TOTAL}) AS BIGINT)) "
        f"THEN {_HIGH.format('e.key')} ELSE a.found END AS found), a -> a.found) AS DOUBLE) END"
    ), "High edge of the bucket that holds a quantile; over 1 in percent"),
    Function("hdr_value_at_quantile", "h MAP<BIGINT, BIGINT>, p DOUBLE", "DOUBLE", "hdr_percentile(h, p)", "The same as hdr_percentile"),
)


def _ip6(text: str | None) -> bytes | None:
    try:
        return ipaddress.IPv6Address(text).packed if text and "%" not in text else None
    except ValueError:
        return None


def _ip6_text(b: bytes | None) -> str | None:
    return str(ipaddress.IPv6Address(bytes(b))) if b is not None and len(b) == 16 else None


@F.pandas_udf(T.BinaryType())
def ip6(s: pd.Series) -> pd.Series:
    return s.map(_ip6)


@F.pandas_udf(T.StringType())
def ip6_to_string(b: pd.Series) -> pd.Series:
    return b.map(_ip6_text)


@F.pandas_udf(T.BooleanType())
def ip6_in_cidr(b: pd.Series, cidr: pd.Series) -> pd.Series:
    nets: dict[str, tuple[int, int] | None] = {}

    def parsed(text: str) -> tuple[int, int] | None:
        net, slash, prefix = text.partition("/")
        packed = _ip6(net)
        return (int.from_bytes(packed), 128 - int(prefix)) if slash and packed and prefix.isascii() and prefix.isdigit() and int(prefix) <= 128 else None

    def inside(x: bytes | None, text: str | None) -> bool | None:
        if x is None or text is None or len(x) != 16:
            return None
        if text not in nets:
            nets[text] = parsed(text)
        net = nets[text]
        return None if net is None else (int.from_bytes(bytes(x)) ^ net[0]) >> net[1] == 0

    return pd.Series([inside(x, t) for x, t in zip(b, cidr, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def format_ip6_list(bs: pd.Series) -> pd.Series:
    return bs.map(lambda xs: None if xs is None else [_ip6_text(x) for x in xs])


#: Codes of free time formats that are supported; others raise an error.
_CODES = set("YmdHMSfjaAbBypIZzsTFD%")


def strftime_text(fmt: str, ts: pd.Timestamp) -> str:
    """``ts`` in a format of % codes, with ``%.3f``, ``%.6f`` and ``%.9f`` for fractions."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] != "%":
            out.append(fmt[i])
            i += 1
            continue
        if (spec := fmt[i : i + 4]) in ("%.3f", "%.6f", "%.9f", "%.f"[:4]):
            digits = f"{ts.microsecond:06d}000"[: int(spec[2])]
            out.append("." + digits)
            i += 4
            continue
        code = fmt[i + 1 : i + 2]
        if code not in _CODES or not code:
            raise ValueError(f"time format code %{code} is not supported")
        simple = {"f": f"{ts.microsecond * 1000:09d}", "s": str(int(ts.timestamp())), "T": f"{ts:%H:%M:%S}", "F": f"{ts:%Y-%m-%d}", "D": f"{ts:%m/%d/%y}", "Z": "UTC", "z": "+0000", "%": "%"}
        out.append(simple[code] if code in simple else ts.strftime("%" + code))
        i += 2
    return "".join(out)


@F.pandas_udf(T.StringType())
def strftime(fmt: pd.Series, ts: pd.Series) -> pd.Series:
    return pd.Series([None if f is None or t is None or t is pd.NaT else strftime_text(f, t) for f, t in zip(fmt, ts, strict=True)], dtype=object)


@F.pandas_udf(T.MapType(T.LongType(), T.LongType()))
def hdr_histogram(values: pd.Series) -> dict:
    """Grouped aggregate for ad-hoc SQL; large groups take the two-level plan of ``operators.hdr``."""
    v = pd.to_numeric(values, errors="coerce").to_numpy(np.float64, na_value=np.nan)
    v = v[~np.isnan(v)]
    v = v[v >= 0].astype(np.int64)
    bits = np.zeros(len(v), np.int64)
    rest = v >> 8
    while rest.any():
        bits += rest > 0
        rest >>= 1
    low, n = np.unique((v >> bits) << bits, return_counts=True)
    return dict(zip(low.tolist(), n.tolist(), strict=True))


PYTHON_FUNCTIONS = {"ip6": ip6, "ip6_to_string": ip6_to_string, "format_ip6": ip6_to_string, "ip6_in_cidr": ip6_in_cidr, "format_ip6_list": format_ip6_list, "strftime": strftime, "hdr_histogram": hdr_histogram}
#: Names of Spark's own functions that portable queries use with another meaning.
SHADOWED = {"hex": "pcap_hex", "unhex": "pcap_unhex", "date": "fmt_date", "time": "fmt_time"}


def register(spark: SparkSession, shadow: bool = False) -> None:
    """Register every function in the session. With ``shadow`` the four names that Spark uses
    otherwise (``hex unhex date time``) get the portable meaning, for sessions of the command line."""
    if not getattr(spark, "_wirelake_functions", False):
        for f in SQL_FUNCTIONS:
            spark.sql(f.ddl())
        for name, f in PYTHON_FUNCTIONS.items():
            spark.udf.register(name, f)
        spark._wirelake_functions = True
    if shadow:
        spark.udf.register("hex", F.pandas_udf(lambda s: s.map(lambda b: None if b is None else bytes(b).hex()), T.StringType()))
        spark.udf.register("unhex", F.pandas_udf(lambda s: s.map(_unhex), T.BinaryType()))
        spark.udf.register("date", F.pandas_udf(lambda s: s.dt.strftime("%Y-%m-%d").astype(object).where(s.notna(), None), T.StringType()))
        spark.udf.register("time", F.pandas_udf(lambda s: s.dt.strftime("%H:%M:%S.%f").astype(object).where(s.notna(), None), T.StringType()))


def _unhex(s: str | None) -> bytes | None:
    if s is None:
        return None
    s = s.strip()
    s = s[2:] if s[:2] in ("0x", "0X") else s
    try:
        return bytes.fromhex(s) if len(s) % 2 == 0 and " " not in s else None
    except ValueError:
        return None


def register_capture_time(spark: SparkSession, start_us: int | None, end_us: int | None) -> None:
    """``start_time()``, ``end_time()`` and ``relative_time(ts)`` of the open capture."""
    for name, us in (("start_time", start_us), ("end_time", end_us)):
        value = "cast(NULL AS TIMESTAMP_NTZ)" if us is None else f"cast(timestamp_micros({us}L) AS TIMESTAMP_NTZ)"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TIMESTAMP_NTZ RETURN {value}")
    start = "cast(NULL AS BIGINT)" if start_us is None else f"{start_us}L"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION relative_time(ts TIMESTAMP_NTZ) RETURNS DOUBLE RETURN (unix_micros(cast(ts AS TIMESTAMP)) - {start}) / 1e6D")
