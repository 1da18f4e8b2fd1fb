"""TLS records: handshakes, fingerprints, alerts. Shared by the packet decoder and the stream parser."""

from __future__ import annotations

import hashlib
from typing import Any

from wirelake.decode.application import on
from wirelake.decode.core import Hints, Layer, decoder, need, u16
from wirelake.functions.names import TLS_VERSION

PORTS = (443, 8443, 993, 995, 465, 636, 853, 5061, 14433)

# fixed values
CIPHER = {
    0x0000: "TLS_NULL_WITH_NULL_NULL", 0x0001: "TLS_RSA_WITH_NULL_MD5", 0x0002: "TLS_RSA_WITH_NULL_SHA", 0x0004: "TLS_RSA_WITH_RC4_128_MD5", 0x0005: "TLS_RSA_WITH_RC4_128_SHA",
    0x000A: "TLS_RSA_WITH_3DES_EDE_CBC_SHA", 0x0016: "TLS_DHE_RSA_WITH_3DES_EDE_CBC_SHA", 0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA", 0x0033: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA",
    0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA", 0x0039: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA", 0x003C: "TLS_RSA_WITH_AES_128_CBC_SHA256", 0x003D: "TLS_RSA_WITH_AES_256_CBC_SHA256",
    0x0067: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA256", 0x006B: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA256", 0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256", 0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384",
    0x009E: "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256", 0x009F: "TLS_DHE_RSA_WITH_AES_256_GCM_SHA384", 0x00FF: "TLS_EMPTY_RENEGOTIATION_INFO_SCSV", 0x1301: "TLS_AES_128_GCM_SHA256",
    0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256", 0x1304: "TLS_AES_128_CCM_SHA256", 0x1305: "TLS_AES_128_CCM_8_SHA256", 0x5600: "TLS_FALLBACK_SCSV",
    0xC007: "TLS_ECDHE_ECDSA_WITH_RC4_128_SHA", 0xC008: "TLS_ECDHE_ECDSA_WITH_3DES_EDE_CBC_SHA", 0xC009: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA", 0xC00A: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA",
    0xC011: "TLS_ECDHE_RSA_WITH_RC4_128_SHA", 0xC012: "TLS_ECDHE_RSA_WITH_3DES_EDE_CBC_SHA", 0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", 0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA",
    0xC023: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256", 0xC024: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA384", 0xC027: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256", 0xC028: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384",
    0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384", 0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", 0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    0xCCA8: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256", 0xCCA9: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256", 0xCCAA: "TLS_DHE_RSA_WITH_CHACHA20_POLY1305_SHA256",
}
_SIGNATURE = {
    0x0201: "rsa_pkcs1_sha1", 0x0203: "ecdsa_sha1", 0x0401: "rsa_pkcs1_sha256", 0x0403: "ecdsa_secp256r1_sha256", 0x0501: "rsa_pkcs1_sha384", 0x0503: "ecdsa_secp384r1_sha384", 0x0601: "rsa_pkcs1_sha512",
    0x0603: "ecdsa_secp521r1_sha512", 0x0804: "rsa_pss_rsae_sha256", 0x0805: "rsa_pss_rsae_sha384", 0x0806: "rsa_pss_rsae_sha512", 0x0807: "ed25519", 0x0808: "ed448", 0x0809: "rsa_pss_pss_sha256",
    0x080A: "rsa_pss_pss_sha384", 0x080B: "rsa_pss_pss_sha512",
}
_GROUP = dict(enumerate(
    "sect163k1 sect163r1 sect163r2 sect193r1 sect193r2 sect233k1 sect233r1 sect239k1 sect283k1 sect283r1 sect409k1 sect409r1 sect571k1 sect571r1 secp160k1 secp160r1 secp160r2 secp192k1 secp192r1 "
    "secp224k1 secp224r1 secp256k1 secp256r1 secp384r1 secp521r1 brainpoolP256r1 brainpoolP384r1 brainpoolP512r1 x25519 x448".split(), 1
)) | {256: "ffdhe2048", 257: "ffdhe3072", 258: "ffdhe4096", 259: "ffdhe6144", 260: "ffdhe8192"}
_POINT = {0: "uncompressed", 1: "ansiX962_compressed_prime", 2: "ansiX962_compressed_char2"}
_COMPRESSION = {0: "null", 1: "DEFLATE", 64: "LZS"}
_ALERT = {
    0: "close_notify", 10: "unexpected_message", 20: "bad_record_mac", 21: "decryption_failed", 22: "record_overflow", 30: "decompression_failure", 40: "handshake_failure", 41: "no_certificate",
    42: "bad_certificate", 43: "unsupported_certificate", 44: "certificate_revoked", 45: "certificate_expired", 46: "certificate_unknown", 47: "illegal_parameter", 48: "unknown_ca", 49: "access_denied",
    50: "decode_error", 51: "decrypt_error", 60: "export_restriction", 70: "protocol_version", 71: "insufficient_security", 80: "internal_error", 86: "inappropriate_fallback", 90: "user_canceled",
    100: "no_renegotiation", 109: "missing_extension", 110: "unsupported_extension", 111: "certificate_unobtainable", 112: "unrecognized_name", 113: "bad_certificate_status_response",
    114: "bad_certificate_hash_value", 115: "unknown_psk_identity", 116: "certificate_required", 120: "no_application_protocol",
}


def grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A


def version_name(v: int) -> str:
    return TLS_VERSION.get(v) or ("GREASE" if grease(v) else f"Unknown (0x{v:04x})")


def cipher_name(v: int) -> str:
    return f"GREASE (0x{v:04x})" if grease(v) else CIPHER.get(v, f"0x{v:04X}")


def _named(v: int, table: dict[int, str], digits: int = 4) -> str:
    return table.get(v) or ("GREASE" if digits == 4 and grease(v) else f"0x{v:0{digits}x}")


def _words(b: bytes) -> list[int]:
    return [u16(b, i) for i in range(0, len(b) - 1, 2)]


def extensions(b: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at + 4 <= len(b):
        n = u16(b, at + 2)
        out.append((u16(b, at), b[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def _extension_fields(found: list[tuple[int, bytes]], server: bool) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for kind, v in found:
        if kind == 0 and not server and len(v) > 5:
            out["sni"] = v[5 : 5 + u16(v, 3)].decode("utf-8", "replace")
        elif kind == 16 and len(v) > 2:
            names, at = [], 2
            while at < len(v):
                names.append(v[at + 1 : at + 1 + v[at]].decode("utf-8", "replace"))
                at += 1 + v[at]
            out["alpn"] = ";".join(names)
        elif kind == 43:
            versions = _words(v) if server else _words(v[1:])
            if versions:
                out["supported_versions"] = ";".join(version_name(x) for x in versions)
        elif kind == 13 and len(v) > 2:
            out["signature_algorithms"] = ";".join(_named(x, _SIGNATURE) for x in _words(v[2:]))
        elif kind == 10 and len(v) > 2:
            out["supported_groups"] = ";".join(_named(x, _GROUP) for x in _words(v[2:]))
        elif kind == 11 and len(v) > 1:
            out["ec_point_formats"] = ";".join(_named(x, _POINT, 2) for x in v[1 : 1 + v[0]])
    if found:
        out["extension_types"] = ",".join(str(k) for k, _ in found)
    return out


def _md5(text: str) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def client_hello(b: bytes) -> dict[str, Any]:
    """Fields of the body of a ClientHello."""
    need(b, 35)
    version, n = u16(b, 0), b[34]
    at = 35 + n
    need(b, at + 2)
    ciphers = _words(b[at + 2 : at + 2 + u16(b, at)])
    at += 2 + u16(b, at)
    need(b, at + 1)
    methods = b[at + 1 : at + 1 + b[at]]
    at += 1 + b[at]
    size = u16(b, at) if at + 2 <= len(b) else 0
    found = extensions(b[at + 2 : at + 2 + size])
    values = dict(reversed(found))
    ja3 = ",".join((
        str(version), "-".join(str(c) for c in ciphers if not grease(c)), "-".join(str(k) for k, _ in found if not grease(k)),
        "-".join(str(g) for g in _words(values.get(10, b"")[2:]) if not grease(g)), "-".join(str(p) for p in values.get(11, b"")[1:]),
    ))
    return {
        "handshake_version": version, "version": version_name(version), "client_random": b[2:34], "session_id": b[35 : 35 + n] or None, "session_id_length": n, "cipher_suites": ";".join(map(cipher_name, ciphers)),
        "cipher_suite_count": len(ciphers), "compression_methods": ";".join(_named(m, _COMPRESSION, 2) for m in methods), "extensions_length": size, "ja3": ja3, "ja3_hash": _md5(ja3),
    } | _extension_fields(found, False)


def server_hello(b: bytes) -> dict[str, Any]:
    """Fields of the body of a ServerHello."""
    need(b, 38)
    version, n = u16(b, 0), b[34]
    at = 35 + n
    need(b, at + 3)
    cipher, method = u16(b, at), b[at + 2]
    at += 3
    size = u16(b, at) if at + 2 <= len(b) else 0
    found = extensions(b[at + 2 : at + 2 + size])
    ja3s = f"{version},{cipher}," + "-".join(str(k) for k, _ in found if not grease(k))
    return {
        "handshake_version": version, "version": version_name(version), "server_random": b[2:34], "session_id": b[35 : 35 + n] or None, "session_id_length": n, "selected_cipher": cipher_name(cipher),
        "selected_cipher_id": cipher, "selected_compression": method, "extensions_length": size, "ja3s": ja3s, "ja3s_hash": _md5(ja3s),
    } | _extension_fields(found, True)


_PORT = on(*PORTS)


@decoder("tls", lambda h: h.transport == "tcp" and _PORT(h), priority=50, about="Transport layer security")
def tls(b: bytes, h: Hints) -> Layer:
    need(b, 5)
    kind, version, size = b[0], u16(b, 1), u16(b, 3)
    if not 20 <= kind <= 24:
        need(b"", 1)
    out: dict[str, Any] = {"record_type": kind, "record_version": version, "version": version_name(version)}
    body = b[5 : 5 + size]
    need(b, 5 + size, out)
    if kind == 22 and len(body) >= 4:
        out["handshake_type"] = body[0]
        inner = body[4 : 4 + int.from_bytes(body[1:4], "big")]
        if body[0] in (1, 2):
            out |= client_hello(inner) if body[0] == 1 else server_hello(inner)
        elif body[0] == 11 and len(inner) >= 3:
            count, at = 0, 3
            while at + 3 <= len(inner):
                at += 3 + int.from_bytes(inner[at : at + 3], "big")
                count += 1
            out["certificate_count"] = count
    elif kind == 21 and len(body) == 2:
        out |= {"alert_level": body[0], "alert_description": body[1], "alert_description_str": _ALERT.get(body[1], "unknown")}
    elif kind == 20:
        out["is_change_cipher_spec"] = True
    elif kind == 23:
        out |= {"has_app_data": True, "app_data_length": size}
    elif kind == 24:
        out["is_heartbeat"] = True
        if body:
            out["heartbeat_type"] = body[0]
    return out, b"", None
