"""The dispatch loop and the registry of decoders.

A decoder is a function of the bytes and the hints of the layer before. It returns the layer's
fields, the bytes that remain, and the hints for the next layer. The loop asks for the next decoder
by these hints until none wants the bytes. A header that is cut off still gives a row, with NULL
fields. Tunnel headers are at their own depth, what they carry is one deeper.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any


class Short(Exception):
    """The bytes end before the header does; ``fields`` are what was read so far."""

    def __init__(self, fields: dict[str, Any] | None = None) -> None:
        super().__init__("truncated")
        self.fields = fields or {}


@dataclass
class Hints:
    """What a layer says about the next one."""

    link_type: int | None = None
    ethertype: int | None = None
    ip_protocol: int | None = None
    ip_version: int | None = None
    transport: str | None = None
    src_port: int | None = None
    dst_port: int | None = None
    family: int | None = None
    parent: str | None = None
    #: (type, id) of a tunnel that the layer opens
    tunnel: tuple[str, int | None] | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def ports(self) -> tuple[int | None, int | None]:
        return self.src_port, self.dst_port


Layer = tuple[dict[str, Any], bytes, Hints | None]


@dataclass(frozen=True)
class Decoder:
    name: str
    wants: Callable[[Hints], bool]
    parse: Callable[[bytes, Hints], Layer]
    priority: int = 0
    about: str = ""


REGISTRY: list[Decoder] = []
#: Ports that some decoder asks for; all others are alike to the dispatch.
PORTS: set[int] = set()
_CHOSEN: dict[tuple, Decoder | None] = {}


def decoder(name: str, wants: Callable[[Hints], bool], priority: int = 0, about: str = "", ports: tuple[int, ...] = ()) -> Callable:
    """Register a decoder; of several that want a layer the greatest priority wins, then the last.

    ``wants`` may look at every hint, but at the numbers of ports only if they are in ``ports`` of some
    decoder, as its answers are kept.
    """
    PORTS.update(ports)

    def add(parse: Callable[[bytes, Hints], Layer]) -> Callable[[bytes, Hints], Layer]:
        REGISTRY.append(Decoder(name, wants, parse, priority, about))
        _CHOSEN.clear()
        return parse

    return add


def loaded() -> list[Decoder]:
    """The registry with all decoders; a worker that unpickled a task has only this module at first."""
    if not REGISTRY:
        for name in ("link", "network", "application", "tls"):
            importlib.import_module(f"wirelake.decode.{name}")
    return REGISTRY


def chosen(hints: Hints) -> Decoder | None:
    """The decoder of the next layer."""
    sport, dport = hints.src_port, hints.dst_port
    key = (
        hints.link_type, hints.ethertype, hints.ip_protocol, hints.ip_version, hints.transport, sport if sport in PORTS else sport is None, dport if dport in PORTS else dport is None, hints.parent, hints.family,
        "rt_type" in hints.extra, bool(hints.extra.get("netlink")),
    )
    if key in _CHOSEN:
        return _CHOSEN[key]
    best = None
    for d in REGISTRY or loaded():
        if (best is None or d.priority >= best.priority) and d.wants(hints):
            best = d
    if len(_CHOSEN) > 100_000:
        _CHOSEN.clear()
    _CHOSEN[key] = best
    return best


#: Decoders after which no other comes, and those after which only some come; all others may lead anywhere.
LEADS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("arp", "icmp", "icmpv6", "ospf", "bgp", "dns", "dhcp", "ntp", "tls", "ssh", "quic", "rtnetlink"), ()),
    "tcp": ("dns", "bgp", "tls", "ssh"), "udp": ("dns", "dhcp", "ntp", "quic", "vxlan", "gtp"), "netlink": ("rtnetlink",),
}


def leading_to(name: str) -> frozenset[str] | None:
    """Decoders that have to run for the layers of one protocol: its own and those that may stand before
    it. None, meaning all, where a decoder was added of which that is not known."""
    known = {d.name for d in loaded()}
    open_ = {"ethernet", "linux_sll", "vlan", "mpls", "ipv4", "ipv6", "gre", "vxlan", "gtp", "ipsec"}
    if not known <= open_ | set(LEADS):
        return None
    found, before = {name}, set()
    while found != before:
        before = set(found)
        found |= {n for n in known if n in open_ or set(LEADS[n]) & found}
    return frozenset(found)


def walk(data: bytes, link_type: int, needed: frozenset[str] | None = None) -> Iterator[tuple[str, int, str | None, int | None, dict[str, Any], bytes]]:
    """(protocol, depth, tunnel type, tunnel id, fields, bytes behind it) of every layer of a frame. The
    walk ends before a decoder that is not among the ``needed``, if these are given."""
    hints, depth, tunnel = Hints(link_type=link_type), 0, (None, None)
    while data and (d := chosen(hints)) is not None and (needed is None or d.name in needed):
        try:
            fields, data, nxt = d.parse(data, hints)
        except Short as e:
            yield d.name, depth, *tunnel, e.fields, b""
            return
        except (IndexError, ValueError, UnicodeError):
            yield d.name, depth, *tunnel, {}, b""
            return
        yield d.name, depth, *tunnel, fields, data
        if nxt is None:
            return
        nxt.parent = d.name
        if nxt.tunnel is not None:
            tunnel, depth = nxt.tunnel, min(depth + 1, 255)
        hints = nxt


def layers(data: bytes, link_type: int, needed: frozenset[str] | None = None) -> Iterator[tuple[str, int, str | None, int | None, dict[str, Any]]]:
    """:func:`walk` without the bytes."""
    for layer in walk(data, link_type, needed):
        yield layer[:5]


def need(data: bytes, n: int, fields: dict[str, Any] | None = None) -> None:
    if len(data) < n:
        raise Short(fields)


def u16(b: bytes, i: int) -> int:
    return (b[i] << 8) | b[i + 1]


def u32(b: bytes, i: int) -> int:
    return int.from_bytes(b[i : i + 4], "big")


def quad(b: bytes, i: int = 0) -> str:
    return f"{b[i]}.{b[i + 1]}.{b[i + 2]}.{b[i + 3]}"
