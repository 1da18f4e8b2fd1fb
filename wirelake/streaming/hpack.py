"""Header compression of HTTP/2 (RFC 7541), decoding side."""

from __future__ import annotations

from collections import deque

# The static table, name and value.
_STATIC = [tuple(x.split("=", 1)) for x in (
    ":authority= :method=GET :method=POST :path=/ :path=/index.html :scheme=http :scheme=https :status=200 :status=204 :status=206 :status=304 :status=400 :status=404 :status=500 accept-charset= "
    "accept-encoding=gzip,~deflate accept-language= accept-ranges= accept= access-control-allow-origin= age= allow= authorization= cache-control= content-disposition= content-encoding= content-language= "
    "content-length= content-location= content-range= content-type= cookie= date= etag= expect= expires= from= host= if-match= if-modified-since= if-none-match= if-range= if-unmodified-since= last-modified= "
    "link= location= max-forwards= proxy-authenticate= proxy-authorization= range= referer= refresh= retry-after= server= set-cookie= strict-transport-security= transfer-encoding= user-agent= vary= via= "
    "www-authenticate="
).replace("~", "\0").split(" ")]
STATIC = [(n, v.replace("\0", " ")) for n, v in _STATIC]

# The code is canonical, so the symbols of each code length give it; 256 ends a text.
_LENGTHS = {
    5: b"012aceiost", 6: b" %-./3456789=A_bdfghlmnpru", 7: b":BCDEFGHIJKLMNOPQRSTUVWYjkqvwxyz", 8: b"&*,;XZ", 10: b"!\"()?", 11: b"'+|", 12: b"#>", 13: b"\0$@[]~", 14: b"^}", 15: b"<`{", 19: (92, 195, 208),
    20: (128, 130, 131, 162, 184, 194, 224, 226), 21: (153, 161, 167, 172, 176, 177, 179, 209, 216, 217, 227, 229, 230),
    22: (129, 132, 133, 134, 136, 146, 154, 156, 160, 163, 164, 169, 170, 173, 178, 181, 185, 186, 187, 189, 190, 196, 198, 228, 232, 233),
    23: (1, 135, 137, 138, 139, 140, 141, 143, 147, 149, 150, 151, 152, 155, 157, 158, 165, 166, 168, 174, 175, 180, 182, 183, 188, 191, 197, 231, 239), 24: (9, 142, 144, 145, 148, 159, 171, 206, 215, 225, 236, 237),
    25: (199, 207, 234, 235), 26: (192, 193, 200, 201, 202, 205, 210, 213, 218, 219, 238, 240, 242, 243, 255),
    27: (203, 204, 211, 212, 214, 221, 222, 223, 241, 244, 245, 246, 247, 248, 250, 251, 252, 253, 254),
    28: (2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 23, 24, 25, 26, 27, 28, 29, 30, 31, 127, 220, 249), 30: (10, 13, 22, 256),
}


def _codes() -> dict[tuple[int, int], int]:
    out, code, before = {}, 0, 0
    for bits, symbols in _LENGTHS.items():
        code <<= bits - before
        for s in sorted(symbols):
            out[bits, code] = s
            code += 1
        before = bits
    return out


_CODES = _codes()


class HpackError(ValueError):
    """A header block that breaks the rules."""


def huffman(data: bytes) -> bytes:
    """Text of a Huffman-coded string; the padding is the beginning of the end mark."""
    out, code, bits = bytearray(), 0, 0
    for byte in data:
        for shift in range(7, -1, -1):
            code = (code << 1) | ((byte >> shift) & 1)
            bits += 1
            if (s := _CODES.get((bits, code))) is not None:
                if s == 256:
                    raise HpackError("end mark inside a string")
                out.append(s)
                code = bits = 0
            elif bits > 30:
                raise HpackError("no such code")
    if bits > 7 or code != (1 << bits) - 1:
        raise HpackError("bad padding")
    return bytes(out)


class Decoder:
    """The decoder of one direction with its dynamic table."""

    def __init__(self, size: int = 4096) -> None:
        self.limit = self.size = size
        self.table: deque[tuple[str, str]] = deque()
        self.used = 0

    def _integer(self, b: bytes, at: int, bits: int) -> tuple[int, int]:
        most = (1 << bits) - 1
        value = b[at] & most
        at += 1
        if value < most:
            return value, at
        shift = 0
        while True:
            byte = b[at]
            at += 1
            value += (byte & 127) << shift
            shift += 7
            if not byte & 128:
                return value, at
            if shift > 35:
                raise HpackError("integer too long")

    def _string(self, b: bytes, at: int) -> tuple[str, int]:
        coded = b[at] & 128
        n, at = self._integer(b, at, 7)
        if at + n > len(b):
            raise HpackError("string is cut off")
        raw = b[at : at + n]
        return (huffman(raw) if coded else raw).decode("utf-8", "replace"), at + n

    def _entry(self, i: int) -> tuple[str, str]:
        if 1 <= i <= len(STATIC):
            return STATIC[i - 1]
        i -= len(STATIC) + 1
        if not 0 <= i < len(self.table):
            raise HpackError("no such table entry")
        return self.table[i]

    def _shrink(self) -> None:
        while self.used > self.size and self.table:
            n, v = self.table.pop()
            self.used -= len(n.encode()) + len(v.encode()) + 32

    def decode(self, b: bytes) -> list[tuple[str, str]]:
        """The headers of a block."""
        out, at = [], 0
        try:
            while at < len(b):
                first = b[at]
                if first & 128:
                    i, at = self._integer(b, at, 7)
                    out.append(self._entry(i))
                elif first & 0xE0 == 0x20:
                    self.size, at = self._integer(b, at, 5)
                    if self.size > max(self.limit, 65536):
                        raise HpackError("table too large")
                    self._shrink()
                else:
                    index = first & 0x40
                    i, at = self._integer(b, at, 6 if index else 4)
                    name, at = (self._entry(i)[0], at) if i else self._string(b, at)
                    value, at = self._string(b, at)
                    out.append((name, value))
                    if index:
                        self.table.appendleft((name, value))
                        self.used += len(name.encode()) + len(value.encode()) + 32
                        self._shrink()
        except IndexError as e:
            raise HpackError("block is cut off") from e
        return out
