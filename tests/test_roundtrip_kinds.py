"""Decoder queries over captures of their own kinds of packets, written from more or stranger rows than
those of the round trips."""

from __future__ import annotations

import time

import packets as P
import pytest

from wirelake.plans import roundtrip
from wirelake.sources import container

DECODERS = ("arp", "dns", "gtp", "bgp", "ethernet", "icmp", "ipv4", "dhcp", "gre", "icmpv6")


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("mixed")
    keys = [*range(1, 200), *range(65_600, 65_664), 37, 40, *range(9_000_000, 9_000_032), None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{d}/orders.parquet")
    return str(d), [k for k in keys if k is not None]


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", DECODERS)
def test_own_kinds_alone_give_the_rows_of_a_mixed_capture(spark, mixed, name):
    d, keys = mixed
    kinds = roundtrip.DECODED[name][0]
    own = _sorted(roundtrip.QUERIES[f"decode_{name}"](spark, d))
    # every packet of its kinds was written and no other
    assert roundtrip.opened(spark, d, kinds).table("frames").count() == sum(k % roundtrip.KINDS in kinds for k in keys)
    assert own == _sorted(roundtrip._decoded_rows(roundtrip.opened(spark, d), name)) and len(own) == sum(k % roundtrip.KINDS in kinds for k in keys)


def test_no_rows_of_a_kind(spark, tmp_path):
    spark.createDataFrame([(5,), (None,)], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert roundtrip.QUERIES["decode_arp"](spark, str(tmp_path)).collect() == []


def test_captures_are_written_in_time_by_their_size(tmp_path):
    began = time.process_time()
    data = P.pcap([bytes(100)] * 100_000)
    assert len(data) == 24 + 116 * 100_000 and time.process_time() - began < 20
    (tmp_path / "x").write_bytes(data)
    with open(tmp_path / "x", "rb") as f:
        assert [r[0] for r in container.records(container.opened(f))] == [1_700_000_000_000_000 + 1000 * i for i in range(100_000)]
