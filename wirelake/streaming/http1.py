"""HTTP/1 messages of a byte stream."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

PORTS = (80, 8080, 8000, 8888, 3000, 5000)
_METHODS = (b"GET ", b"POST ", b"PUT ", b"DELETE ", b"HEAD ", b"OPTIONS ", b"PATCH ", b"CONNECT ", b"TRACE ")
MOST_HEADERS = 100
#: header -> column
_COLUMNS = {h: h.replace("-", "_") for h in (
    "host", "content-type", "user-agent", "server", "transfer-encoding", "connection", "cookie", "set-cookie", "referer", "accept", "accept-encoding", "accept-language", "cache-control", "location",
    "x-forwarded-for", "x-real-ip", "authorization",
)}


@dataclass
class Message:
    is_request: bool
    start: int
    end: int
    complete: bool
    fields: dict[str, Any] = field(default_factory=dict)


def is_http(data: bytes) -> bool:
    return data.startswith(_METHODS) or data.startswith(b"HTTP/1.")


def messages(data: bytes, closed: bool = False) -> list[Message]:
    """Messages from the beginning of a stream; stops at what is none or is cut off.

    A body ends by its length or its last chunk. A response without either has an empty body, as
    nothing in the stream tells where it ends; ``closed`` streams keep the rest as its body.
    """
    out, at = [], 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0 or not is_http(data[at : at + 16]):
            break
        lines = data[at:head_end].decode("latin-1").split("\r\n")
        parts = lines[0].split(" ", 2)
        request = not lines[0].startswith("HTTP/")
        fields: dict[str, Any] = {"is_request": request, "headers_complete": True}
        if request:
            fields |= {"method": parts[0], "uri": parts[1] if len(parts) > 1 else None, "version": parts[2] if len(parts) > 2 else None}
        else:
            code = parts[1] if len(parts) > 1 else ""
            fields |= {"version": parts[0], "status_code": int(code) if code.isdigit() else None, "status_text": parts[2] if len(parts) > 2 else None}
        length, chunked = None, False
        for line in lines[1 : MOST_HEADERS + 1]:
            name, colon, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if not colon:
                continue
            if name == "content-length" and value.isdigit():
                length = fields["content_length"] = int(value)
            elif name in _COLUMNS and _COLUMNS[name] not in fields:
                # credentials stay out of tables: only the scheme is kept
                fields[_COLUMNS[name]] = value.split(" ", 1)[0] if name == "authorization" else value
            if name == "transfer-encoding" and "chunked" in value.lower():
                chunked = True
        body = head_end + 4
        bodiless = not request and (fields["status_code"] in (204, 304) or 100 <= (fields["status_code"] or 0) < 200)
        if bodiless:
            size, end = 0, body
        elif chunked:
            size, end = _chunks(data, body)
        elif length is not None:
            size, end = length, body + length
        elif not request and closed:
            size, end = len(data) - body, len(data)
        else:
            size, end = 0, body
        done = end is not None and end <= len(data)
        fields["body_length"] = size if done else len(data) - body
        out.append(Message(request, at, end if done else len(data), done, fields))
        if not done:
            break
        at = end
    return out


def _chunks(data: bytes, at: int) -> tuple[int, int | None]:
    """Length of a chunked body and its end, None where it is cut off."""
    total = 0
    while True:
        line_end = data.find(b"\r\n", at)
        if line_end < 0:
            return total, None
        try:
            size = int(data[at:line_end].split(b";", 1)[0].strip(), 16)
        except ValueError:
            return total, None
        at = line_end + 2
        if size == 0:
            # trailers end with an empty line
            while True:
                line_end = data.find(b"\r\n", at)
                if line_end < 0:
                    return total, None
                if line_end == at:
                    return total, at + 2
                at = line_end + 2
        if at + size + 2 > len(data):
            return total, None
        total += size
        at += size + 2
