"""Encryption of values: AES-256-GCM by Spark's own functions, keys by HKDF.

Every data key is derived for one store and one purpose, and every value gets a random 12-byte nonce, so no nonce layout is
shared between purposes. The associated data ties a ciphertext to its key and sequence: a value moved elsewhere fails.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def hkdf(secret: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF with SHA-256 (RFC 5869)."""
    if length > 255 * 32:
        raise ValueError("HKDF gives 8160 bytes at most")
    key = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < length:
        block = hmac.new(key, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:length]


def key_id(master: bytes) -> str:
    """A name of a master key that does not give it away."""
    return hmac.new(master, b"stratalog key id", hashlib.sha256).digest()[:16].hex()


def data_key(master: bytes, identity: str, purpose: str) -> bytes:
    return hkdf(master, identity.encode(), f"stratalog {purpose}".encode())


def associated(purpose: str, key: Column, seq: Column) -> Column:
    return F.concat(F.encode(F.lit(f"{purpose}:"), "UTF-8"), F.encode(F.format_string("%020d:", seq), "UTF-8"), key)


def seal(value: Column, secret: bytes, aad: Column) -> Column:
    """Nonce, ciphertext and tag in one byte string; null stays null."""
    return F.aes_encrypt(value, F.lit(secret), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit("")), aad)


def open_sealed(value: Column, secret: bytes, aad: Column) -> Column:
    """The value; the query fails if the key, the place or the bytes are wrong."""
    return F.aes_decrypt(value, F.lit(secret), F.lit("GCM"), F.lit("DEFAULT"), aad)


def try_open(value: Column, secret: bytes, aad: Column) -> Column:
    """The value, or null if the key, the place or the bytes are wrong."""
    return F.try_aes_decrypt(value, F.lit(secret), F.lit("GCM"), F.lit("DEFAULT"), aad)
