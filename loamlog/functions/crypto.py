"""Hashes, checksums and encryption of columns."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def crc32(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def derive_key(password: str, salt: bytes, info: bytes = b"loamlog-key-v1", length: int = 32) -> bytes:
    """HKDF with SHA-256."""
    prk = hmac.new(salt, password.encode(), hashlib.sha256).digest()
    out, block = b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


def _key(key: bytes) -> Column:
    if len(key) != 32:
        raise ValueError("keys have 32 bytes")
    return F.lit(bytearray(key))


def encrypt(c: Column, key: bytes, aad: bytes | None = None) -> Column:
    """AES-256-GCM with a random nonce, which the result begins with."""
    args = [F.lit("GCM"), F.lit("DEFAULT")] + ([F.lit(bytearray()), F.lit(bytearray(aad))] if aad is not None else [])
    return F.aes_encrypt(c.cast("binary"), _key(key), *args)


def decrypt(c: Column, key: bytes, aad: bytes | None = None) -> Column:
    """What encrypt() made of it; null where key, nonce or additional data don't fit."""
    args = [F.lit("GCM"), F.lit("DEFAULT")] + ([F.lit(bytearray(aad))] if aad is not None else [])
    return F.try_aes_decrypt(c.cast("binary"), _key(key), *args)


def entity_id(text: Column) -> Column:
    """16 bytes from a UUID's text, or null."""
    raw = F.unhex(F.replace(text, F.lit("-"), F.lit("")))
    return F.when(F.octet_length(raw) == 16, raw)


def new_entity_id() -> Column:
    return F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))
