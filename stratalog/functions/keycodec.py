"""Codecs of keys and pointers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAX_SEQ


def ordered_int(value: Column) -> Column:
    """A bigint as eight bytes that sort as the number does."""
    return F.unhex(F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def ordered_text(value: Column) -> Column:
    """Text as bytes that sort as its UTF-8 does, ended so that composite keys sort by their parts: a zero byte becomes
    00 7F, and 00 00 ends the part."""
    return F.concat(F.encode(F.regexp_replace(value, "\\x00", "\x00\x7f"), "UTF-8"), F.unhex(F.lit("0000")))


def composite(*parts: Column) -> Column:
    return F.concat(*parts)


def trailer(seq: Column, kind: Column) -> Column:
    """Eight bytes that sort by sequence downwards, then by kind."""
    inverted = F.bitwise_not(seq).bitwiseAND(F.lit(MAX_SEQ))
    return F.unhex(F.lpad(F.hex(F.shiftleft(inverted, 8).bitwiseOR(kind.cast("long"))), 16, "0"))


def encode_internal(key: Column, seq: Column, kind: Column) -> Column:
    """Key, inverted sequence and kind in one byte string; sorts like them only among keys of which none begins another."""
    return F.concat(key, trailer(seq, kind))


def lookup_key(key: Column, seq: Column) -> Column:
    return encode_internal(key, seq, F.lit(0))


def user_key(internal: Column) -> Column:
    return F.substring(internal, F.lit(1), F.octet_length(internal) - 8)


def _tail(internal: Column) -> Column:
    return F.hex(F.substring(internal, F.octet_length(internal) - 7, F.lit(8)))


def seq_of(internal: Column) -> Column:
    return F.bitwise_not(F.conv(F.substring(_tail(internal), 1, 14), 16, 10).cast("long")).bitwiseAND(F.lit(MAX_SEQ))


def kind_of(internal: Column) -> Column:
    return F.conv(F.substring(_tail(internal), 15, 2), 16, 10).cast("int")


def compare(a_key: Column, a_seq: Column, b_key: Column, b_seq: Column) -> Column:
    """-1, 0 or 1: by key upwards, then by sequence downwards."""
    return (
        F.when(a_key < b_key, -1).when(a_key > b_key, 1).when(a_seq > b_seq, -1).when(a_seq < b_seq, 1).otherwise(0)
    )


def encode_pointer(pointer: Column) -> Column:
    """A pointer struct as 16 bytes, big-endian: file number, row, length."""
    cells = [F.lpad(F.right(F.hex(pointer[n].cast("long")), F.lit(w)), w, "0") for n, w in (("file_num", 8), ("row_id", 16), ("length", 8))]
    return F.unhex(F.concat(*cells))


def decode_pointer(data: Column) -> Column:
    h = F.hex(data)

    def cell(at: int, width: int, kind: str) -> Column:
        return F.conv(F.substring(h, at, width), 16, -10).cast(kind)

    return F.struct(cell(1, 8, "int").alias("file_num"), cell(9, 16, "long").alias("row_id"), cell(25, 8, "int").alias("length"))
