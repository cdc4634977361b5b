"""Bytes as people write them, codecs of fixed layouts, key digests."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_bytes(text: str) -> bytes:
    """``0x..`` is hex, anything else UTF-8."""
    if text[:2] in ("0x", "0X"):
        return bytes.fromhex(text[2:])
    return text.encode()


def format_bytes(value: bytes) -> str:
    """UTF-8 if it is printable, else ``0x`` hex."""
    try:
        text = value.decode()
    except UnicodeDecodeError:
        return "0x" + value.hex()
    return text if text.isprintable() else "0x" + value.hex()


def format_value(value: Column) -> Column:
    """:func:`format_bytes` of a binary column, without Python."""
    text = F.try_validate_utf8(value.cast("string"))
    return F.when(text.isNotNull() & ~F.rlike(text, F.lit(r"[\p{C}\p{Zl}\p{Zp}]|[^\S ]")), text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(value))))


def unsigned(part: Column) -> Column:
    """Up to 8 big-endian bytes as an unsigned DECIMAL(20,0)."""
    return F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")


def digest_halves(key: Column) -> tuple[Column, Column]:
    """First 16 bytes of a binary key, zero padded, as two unsigned 64-bit numbers; equal to one 128-bit number in order."""
    padded = F.concat(key, F.unhex(F.lit("00" * 16)))
    return unsigned(F.substring(padded, 1, 8)), unsigned(F.substring(padded, 9, 8))


def digest_u128(key: bytes) -> int:
    return int.from_bytes(key[:16].ljust(16, b"\0"), "big")


def internal_key(key: bytes, seq: int) -> bytes:
    """A key that sorts newer versions first: the key, then the complement of the sequence number."""
    return key + ((1 << 64) - 1 - seq).to_bytes(8, "big")


def split_internal_key(raw: bytes) -> tuple[bytes, int]:
    return raw[:-8], (1 << 64) - 1 - int.from_bytes(raw[-8:], "big")


#: Little-endian layouts of benchmark values.
LAYOUTS = {"warehouse": ("<q", ("balance",)), "item": ("<q", ("price",)), "stock": ("<i", ("quantity",)), "order": ("<Iq", ("item_count", "total")), "order_line": ("<IIq", ("item_id", "quantity", "amount"))}


def encode(kind: str, **fields) -> bytes:
    layout, names = LAYOUTS[kind]
    return struct.pack(layout, *(fields[n] for n in names))


def decode(kind: str, raw: bytes) -> dict:
    layout, names = LAYOUTS[kind]
    return dict(zip(names, struct.unpack(layout, raw), strict=True))


def signed_le(raw: Column, start: int, size: int) -> Column:
    """A little-endian signed integer of ``size`` bytes at ``start`` (from 1) of a binary column, without Python."""
    shift = 64 - 8 * size
    value = F.lit(0).cast("long")
    for i in range(size):
        byte = F.conv(F.hex(F.substring(raw, start + i, 1)), 16, 10).cast("long")
        value = value.bitwiseOR(F.shiftleft(byte, 8 * i))
    return F.shiftright(F.shiftleft(value, shift), shift) if shift else value
