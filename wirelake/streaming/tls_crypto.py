"""Decryption of recorded TLS with a key log: key schedules and the two families of ciphers.

Everything is written out over numpy and hashlib, as no cryptography package is at hand; the cipher
works on all blocks of a record at once. Suites it does not know leave records encrypted.
"""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

import numpy as np

#: suite -> (cipher, key length, hash)
SUITES = {
    0x1301: ("gcm", 16, "sha256"), 0x1302: ("gcm", 32, "sha384"), 0x1303: ("chacha", 32, "sha256"), 0x009C: ("gcm", 16, "sha256"), 0x009D: ("gcm", 32, "sha384"), 0x009E: ("gcm", 16, "sha256"),
    0x009F: ("gcm", 32, "sha384"), 0xC02B: ("gcm", 16, "sha256"), 0xC02C: ("gcm", 32, "sha384"), 0xC02F: ("gcm", 16, "sha256"), 0xC030: ("gcm", 32, "sha384"), 0xCCA8: ("chacha", 32, "sha256"),
    0xCCA9: ("chacha", 32, "sha256"), 0xCCAA: ("chacha", 32, "sha256"),
}
_LABELS = (
    "CLIENT_RANDOM", "CLIENT_HANDSHAKE_TRAFFIC_SECRET", "SERVER_HANDSHAKE_TRAFFIC_SECRET", "CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0", "EXPORTER_SECRET", "EARLY_EXPORTER_SECRET",
    "CLIENT_EARLY_TRAFFIC_SECRET",
)


def key_log(text: str) -> dict[bytes, dict[str, bytes]]:
    """Secrets by client random of a key log; remarks and lines that are none are passed over."""
    out: dict[bytes, dict[str, bytes]] = {}
    for line in text.splitlines():
        parts = line.split()
        if len(parts) != 3 or parts[0] not in _LABELS:
            continue
        try:
            random, secret = bytes.fromhex(parts[1]), bytes.fromhex(parts[2])
        except ValueError:
            continue
        if len(random) == 32 and (parts[0] != "CLIENT_RANDOM" or len(secret) == 48):
            out.setdefault(random, {})[parts[0]] = secret
    return out


def prf(secret: bytes, label: bytes, seed: bytes, size: int, algorithm: str) -> bytes:
    """Key expansion of TLS 1.2."""
    seed, out = label + seed, b""
    a = seed
    while len(out) < size:
        a = hmac.digest(secret, a, algorithm)
        out += hmac.digest(secret, a + seed, algorithm)
    return out[:size]


def expand_label(secret: bytes, label: str, context: bytes, size: int, algorithm: str) -> bytes:
    """Key expansion of TLS 1.3."""
    full = b"tls13 " + label.encode()
    info = size.to_bytes(2, "big") + bytes([len(full)]) + full + bytes([len(context)]) + context
    out, block = b"", b""
    for i in range(-(-size // hashlib.new(algorithm).digest_size)):
        block = hmac.digest(secret, block + info + bytes([i + 1]), algorithm)
        out += block
    return out[:size]


def _gf(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a * (b & 1)
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _box() -> np.ndarray:
    """The substitution of AES: inverses in the field, then the affine map."""
    inverse = [0] * 256
    for x in range(1, 256):
        if not inverse[x]:
            y = next(y for y in range(1, 256) if _gf(x, y) == 1)
            inverse[x], inverse[y] = y, x
    out = []
    for x in inverse:
        r = 0x63
        for i in range(5):
            r ^= ((x << i) | (x >> (8 - i))) & 0xFF
        out.append(r)
    return np.array(out, np.uint8)


_S = _box()
_TWO = np.array([_gf(x, 2) for x in range(256)], np.uint8)
_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])


class Aes:
    """AES encryption of many blocks at once."""

    def __init__(self, key: bytes) -> None:
        n = len(key) // 4
        words, con = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        while len(words) < 4 * (n + 7):
            w = list(words[-1])
            if len(words) % n == 0:
                w = [int(_S[x]) for x in w[1:] + w[:1]]
                w[0] ^= con
                con = _gf(con, 2)
            elif n > 6 and len(words) % n == 4:
                w = [int(_S[x]) for x in w]
            words.append([x ^ y for x, y in zip(w, words[-n], strict=True)])
        self.keys = np.array(words, np.uint8).reshape(-1, 16)

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        s = blocks ^ self.keys[0]
        for k in self.keys[1:-1]:
            s = _S[s][:, _SHIFT].reshape(-1, 4, 4)
            turned = np.roll(s, -1, axis=2)
            total = s[:, :, 0] ^ s[:, :, 1] ^ s[:, :, 2] ^ s[:, :, 3]
            s = (s ^ total[:, :, None] ^ _TWO[s ^ turned]).reshape(-1, 16) ^ k
        return _S[s][:, _SHIFT] ^ self.keys[-1]


def _ghash(h: int, data: bytes) -> int:
    # multiples of the key by each bit, from which bytes take their products
    multiples, v = [], h
    for _ in range(128):
        multiples.append(v)
        v = (v >> 1) ^ (0xE1 << 120 if v & 1 else 0)
    table = []
    for place in range(16):
        row = [0] * 256
        for bit in range(8):
            step = 1 << (7 - bit)
            for x in range(256):
                if x & step:
                    row[x] ^= multiples[place * 8 + bit]
        table.append(row)
    y = 0
    for i in range(0, len(data), 16):
        y ^= int.from_bytes(data[i : i + 16], "big")
        z = 0
        for place, byte in enumerate(y.to_bytes(16, "big")):
            z ^= table[place][byte]
        y = z
    return y


def _padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % 16)


def gcm(key: bytes, nonce: bytes, data: bytes, aad: bytes, tag: bytes | None) -> tuple[bytes, bytes] | None:
    """The other side of ``data`` and the tag over the ciphertext. With ``tag`` the data is
    ciphertext, and None says that the tag is wrong; without, it is plaintext."""
    aes, n = Aes(key), -(-len(data) // 16)
    counters = np.zeros((n + 1, 16), np.uint8)
    counters[:, :12] = np.frombuffer(nonce, np.uint8)
    counters[:, 12:] = np.arange(1, n + 2, dtype=">u4").view(np.uint8).reshape(-1, 4)
    streams = aes.encrypt(counters)
    other = (np.frombuffer(data, np.uint8) ^ streams[1:].reshape(-1)[: len(data)]).tobytes()
    h = int.from_bytes(aes.encrypt(np.zeros((1, 16), np.uint8)).tobytes(), "big")
    text = data if tag is not None else other
    lengths = (len(aad) * 8).to_bytes(8, "big") + (len(text) * 8).to_bytes(8, "big")
    mac = (_ghash(h, _padded(aad) + _padded(text) + lengths) ^ int.from_bytes(streams[0].tobytes(), "big")).to_bytes(16, "big")
    return None if tag is not None and not hmac.compare_digest(mac, tag) else (other, mac)


def _chacha_blocks(key: bytes, nonce: bytes, first: int, n: int) -> bytes:
    state = np.empty((16, n), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    state[12] = np.arange(first, first + n, dtype=np.uint32)
    state[13:] = np.frombuffer(nonce, "<u4")[:, None]
    x = state.copy()

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for p, q, r, bits in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[p] += x[q]
            t = x[r] ^ x[p]
            x[r] = (t << np.uint32(bits)) | (t >> np.uint32(32 - bits))

    for _ in range(10):
        for i in range(4):
            quarter(i, 4 + i, 8 + i, 12 + i)
        for i in range(4):
            quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
    return (x + state).T.astype("<u4").tobytes()


def chacha(key: bytes, nonce: bytes, data: bytes, aad: bytes, tag: bytes | None) -> tuple[bytes, bytes] | None:
    """ChaCha20-Poly1305 with the conventions of :func:`gcm`."""
    stream = _chacha_blocks(key, nonce, 0, 1 + -(-len(data) // 64))
    other = (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream, np.uint8)[64 : 64 + len(data)]).tobytes()
    text = data if tag is not None else other
    message = _padded(aad) + _padded(text) + len(aad).to_bytes(8, "little") + len(text).to_bytes(8, "little")
    r = int.from_bytes(stream[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    total, prime = 0, (1 << 130) - 5
    for i in range(0, len(message), 16):
        total = (total + int.from_bytes(message[i : i + 16] + b"\1", "little")) * r % prime
    mac = ((total + int.from_bytes(stream[16:32], "little")) & ((1 << 128) - 1)).to_bytes(16, "little")
    return None if tag is not None and not hmac.compare_digest(mac, tag) else (other, mac)


@dataclass
class Keys:
    """Keys of one direction; records are counted from the last change of keys."""

    cipher: str
    key: bytes
    iv: bytes
    tls13: bool
    seq: int = 0

    def open(self, kind: int, version: int, body: bytes) -> bytes | None:
        """Plaintext of a record, with the content type at its end in TLS 1.3; None if it fails."""
        seq = self.seq.to_bytes(8, "big")
        if self.tls13 or self.cipher == "chacha":
            nonce, sealed = (int.from_bytes(self.iv, "big") ^ self.seq).to_bytes(12, "big"), body
        else:
            nonce, sealed = self.iv + body[:8], body[8:]
        if len(sealed) < 16:
            return None
        head = bytes([kind]) + version.to_bytes(2, "big")
        aad = head + len(body).to_bytes(2, "big") if self.tls13 else seq + head + (len(sealed) - 16).to_bytes(2, "big")
        done = (gcm if self.cipher == "gcm" else chacha)(self.key, nonce, sealed[:-16], aad, sealed[-16:])
        if done is None:
            return None
        self.seq += 1
        return done[0]


def keys12(suite: int, master: bytes, client_random: bytes, server_random: bytes) -> tuple[Keys, Keys] | None:
    """Keys of client and server under TLS 1.2."""
    if suite not in SUITES or suite in (0x1301, 0x1302, 0x1303):
        return None
    cipher, size, algorithm = SUITES[suite]
    iv = 4 if cipher == "gcm" else 12
    block = prf(master, b"key expansion", server_random + client_random, 2 * size + 2 * iv, algorithm)
    return Keys(cipher, block[:size], block[2 * size : 2 * size + iv], False), Keys(cipher, block[size : 2 * size], block[2 * size + iv :], False)


def keys13(suite: int, secret: bytes) -> Keys | None:
    """Keys of one direction and phase under TLS 1.3."""
    if suite not in (0x1301, 0x1302, 0x1303):
        return None
    cipher, size, algorithm = SUITES[suite]
    return Keys(cipher, expand_label(secret, "key", b"", size, algorithm), expand_label(secret, "iv", b"", 12, algorithm), True)
