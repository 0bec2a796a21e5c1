"""Scalar functions: key codecs, order-preserving encodings, checksums, hashes, encryption, bloom tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def internal_key(key: Column, seq: Column, op: Column) -> Column:
    """key followed by eight bytes, seq << 8 | op big endian; for exchange only, seq must stay below 2 ** 55."""
    packed = F.shiftleft(seq.cast("bigint"), 8).bitwiseOR(op.cast("bigint"))
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(packed), 16, "0")))


def user_key(internal: Column) -> Column:
    return F.substring(internal, F.lit(1), F.octet_length(internal) - 8)


def trailer(internal: Column) -> Column:
    return F.conv(F.hex(F.substring(internal, F.octet_length(internal) - 7, F.lit(8))), 16, 10).cast("bigint")


def seq_of(internal: Column) -> Column:
    return F.shiftrightunsigned(trailer(internal), 8)


def op_of(internal: Column) -> Column:
    return trailer(internal).bitwiseAND(F.lit(255).cast("bigint")).cast("tinyint")


def newest_first_key(key: Column, seq: Column) -> Column:
    """Sorts by key ascending and seq descending as plain bytes (keys of one length, or prefix-free)."""
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(F.bitwise_not(seq.cast("bigint"))), 16, "0")))


def sort_key_long(value: Column, descending: bool = False) -> Column:
    """Sixteen hexadecimal digits that sort as the numbers do: the sign bit is flipped."""
    flipped = value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))
    return F.lpad(F.hex(F.bitwise_not(flipped) if descending else flipped), 16, "0")


def sort_key_text(value: Column) -> Column:
    """The hexadecimal UTF-8 bytes: sorts bytewise under any collation."""
    return F.hex(F.encode(value, "utf-8"))


def checksum(data: Column) -> Column:
    """CRC-32 (IEEE) as BIGINT."""
    return F.crc32(data)


def intact(data: Column, crc: Column) -> Column:
    return F.crc32(data) == crc


def encrypt(value: Column, key: Column, context: Column | None = None) -> Column:
    """AES-GCM with a random nonce; context (the row's key, say) is authenticated with it."""
    extra = () if context is None else (F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), context)
    return F.aes_encrypt(value, key, *extra) if extra else F.aes_encrypt(value, key, F.lit("GCM"))


def decrypt(value: Column, key: Column, context: Column | None = None) -> Column:
    """Fails on a wrong key, a wrong context and changed data."""
    return F.aes_decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), *([] if context is None else [context]))


def file_key(master: Column, name: Column) -> Column:
    """The data key of a file: 32 bytes drawn from the master key and the file's name, so none needs to be kept in the clear."""
    return F.unhex(F.sha2(F.concat(master, name.cast("binary")), 256))


def wrap_key(data_key: Column, master: Column) -> Column:
    """A data key sealed under a master key; what is stored beside the data."""
    return F.aes_encrypt(data_key, master, F.lit("GCM"))


def unwrap_key(wrapped: Column, master: Column) -> Column:
    """Fails on a wrong master key."""
    return F.aes_decrypt(wrapped, master, F.lit("GCM"))


def rewrap_key(wrapped: Column, old: Column, new: Column) -> Column:
    """Rotation: the same data key under a new master key; sealed data stay as they are."""
    return wrap_key(unwrap_key(wrapped, old), new)


def hashed(data: Column) -> Column:
    """64-bit hash for partitioning and sketches."""
    return F.xxhash64(data)


def prefix_shared(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)
