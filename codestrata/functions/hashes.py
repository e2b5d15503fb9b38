"""Keyed hashes from the built-in ones."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def pads(key: str) -> tuple[str, str]:
    """Inner and outer key block of HMAC with SHA-256, as hexadecimal text."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > _BLOCK else k).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 of a text, in hexadecimal; null for null."""
    inner, outer = (F.unhex(F.lit(p)) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
