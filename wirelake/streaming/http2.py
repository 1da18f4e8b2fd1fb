"""HTTP/2 frames of both directions of a connection."""

from __future__ import annotations

from typing import Any

from wirelake.decode.core import u16, u32
from wirelake.streaming.hpack import Decoder, HpackError

PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
# fixed values
FRAME = ("DATA", "HEADERS", "PRIORITY", "RST_STREAM", "SETTINGS", "PUSH_PROMISE", "PING", "GOAWAY", "WINDOW_UPDATE", "CONTINUATION")
ERROR = (
    "NO_ERROR", "PROTOCOL_ERROR", "INTERNAL_ERROR", "FLOW_CONTROL_ERROR", "SETTINGS_TIMEOUT", "STREAM_CLOSED", "FRAME_SIZE_ERROR", "REFUSED_STREAM", "CANCEL", "COMPRESSION_ERROR", "CONNECT_ERROR",
    "ENHANCE_YOUR_CALM", "INADEQUATE_SECURITY", "HTTP_1_1_REQUIRED",
)
SETTING = {1: "HEADER_TABLE_SIZE", 2: "ENABLE_PUSH", 3: "MAX_CONCURRENT_STREAMS", 4: "INITIAL_WINDOW_SIZE", 5: "MAX_FRAME_SIZE", 6: "MAX_HEADER_LIST_SIZE"}
_SETTING_COLUMN = {1: "header_table_size", 3: "max_concurrent_streams", 4: "initial_window_size", 5: "max_frame_size"}
END_STREAM, ACK, END_HEADERS, PADDED, PRIORITY = 1, 1, 4, 8, 32


class Http2:
    """The state of a connection: header tables by direction, streams, a header block in parts."""

    def __init__(self) -> None:
        self.headers = (Decoder(), Decoder())
        self.streams: dict[int, str] = {}
        self.open_block: list[tuple[int, dict[str, Any], bytearray] | None] = [None, None]

    def frames(self, data: bytes, side: int) -> list[tuple[int, dict[str, Any]]]:
        """(end offset, fields) of the frames in the bytes of a side: 0 client, 1 server."""
        out, at = [], len(PREFACE) if side == 0 and data.startswith(PREFACE) else 0
        while at + 9 <= len(data):
            size = int.from_bytes(data[at : at + 3], "big")
            end = at + 9 + size
            if end > len(data):
                break
            out.append((end, self._frame(data[at + 3], data[at + 4], u32(data, at + 5) & 0x7FFFFFFF, data[at + 9 : end], side)))
            at = end
        return out

    def _frame(self, kind: int, flags: int, stream: int, body: bytes, side: int) -> dict[str, Any]:
        out: dict[str, Any] = {"frame_type": FRAME[kind] if kind < len(FRAME) else "UNKNOWN", "stream_id": stream, "flags": flags, "length": len(body)}
        try:
            if kind == 0:
                body = self._unpadded(body, flags, out)
                out |= {"data_length": len(body), "end_stream": bool(flags & END_STREAM)}
            elif kind == 1:
                body = self._unpadded(body, flags, out)
                if flags & PRIORITY:
                    body = self._priority(body, out)
                out |= {"end_stream": bool(flags & END_STREAM), "end_headers": bool(flags & END_HEADERS)}
                self._block(body, flags, stream, side, out)
            elif kind == 2:
                self._priority(body, out)
            elif kind == 3:
                out["error_code"] = u32(body, 0)
            elif kind == 4:
                out["ack"] = bool(flags & ACK)
                found = [(u16(body, i), u32(body, i + 2)) for i in range(0, len(body) - 5, 6)]
                if found:
                    out["settings"] = ", ".join(f"{SETTING.get(k, 'UNKNOWN')}={v}" for k, v in found)
                for k, v in found:
                    if k in _SETTING_COLUMN:
                        out[_SETTING_COLUMN[k]] = v
                    if k == 1:
                        self.headers[1 - side].limit = v
            elif kind == 5:
                body = self._unpadded(body, flags, out)
                out |= {"promised_stream_id": u32(body, 0) & 0x7FFFFFFF, "end_headers": bool(flags & END_HEADERS)}
                self._block(body[4:], flags, stream, side, out)
            elif kind == 6:
                out["ack"] = bool(flags & ACK)
            elif kind == 7:
                out |= {"last_stream_id": u32(body, 0) & 0x7FFFFFFF, "error_code": u32(body, 4), "debug_data": body[8:].decode("utf-8", "replace") or None}
            elif kind == 8:
                out["window_increment"] = u32(body, 0) & 0x7FFFFFFF
            elif kind == 9:
                out["end_headers"] = bool(flags & END_HEADERS)
                if (block := self.open_block[side]) is not None and block[0] == stream:
                    block[2].extend(body)
                    if flags & END_HEADERS:
                        self.open_block[side] = None
                        self._decoded(bytes(block[2]), side, out)
                        out["end_stream"] = block[1].get("end_stream")
        except (IndexError, HpackError):
            pass
        if "error_code" in out:
            out["error_name"] = ERROR[out["error_code"]] if out["error_code"] < len(ERROR) else "UNKNOWN"
        if stream:
            out["stream_state"] = self._advance(stream, kind, out, side)
        return out

    @staticmethod
    def _unpadded(body: bytes, flags: int, out: dict[str, Any]) -> bytes:
        if not flags & PADDED:
            return body
        out["padding_length"] = body[0]
        return body[1 : len(body) - body[0]]

    @staticmethod
    def _priority(body: bytes, out: dict[str, Any]) -> bytes:
        dep = u32(body, 0)
        out |= {"priority_exclusive": bool(dep >> 31), "priority_dependency": dep & 0x7FFFFFFF, "priority_weight": body[4]}
        return body[5:]

    def _block(self, body: bytes, flags: int, stream: int, side: int, out: dict[str, Any]) -> None:
        if flags & END_HEADERS:
            self._decoded(body, side, out)
        else:
            self.open_block[side] = (stream, out, bytearray(body))

    def _decoded(self, block: bytes, side: int, out: dict[str, Any]) -> None:
        found = self.headers[side].decode(block)
        plain = []
        for name, value in found:
            if name in (":method", ":path", ":authority", ":scheme"):
                out[name[1:]] = value
            elif name == ":status":
                out["status"] = int(value) if value.isdigit() else None
            else:
                if name == "content-type":
                    out["content_type"] = value
                elif name == "user-agent":
                    out["user_agent"] = value
                elif name == "content-length" and value.isdigit():
                    out["content_length"] = int(value)
            plain.append(f"{name}: {value}")
        out["response_headers" if "status" in out else "request_headers"] = "; ".join(plain)

    def _advance(self, stream: int, kind: int, out: dict[str, Any], side: int) -> str:
        state = self.streams.get(stream, "idle")
        if kind == 3:
            state = "closed"
        elif kind in (0, 1, 9):
            if state == "idle":
                state = "open"
            if out.get("end_stream") and kind != 9 or (kind == 9 and out.get("end_stream") and out.get("end_headers")):
                mine, other = ("half-closed (local)", "half-closed (remote)") if side == 0 else ("half-closed (remote)", "half-closed (local)")
                state = "closed" if state == other else mine if state == "open" else state
        self.streams[stream] = state
        return state
