"""Position-independent hashes: escaped bytes in order, SHA-256, and the first eight bytes read little-endian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequence_hash(rows: DataFrame, keys: list[str], order: list[str], escaped: Column) -> DataFrame:
    """SHA-256 (hex) of the escaped strings of each key, put together in order."""
    items = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, escaped.alias("_e")))).alias("_s"))
    return items.select(*keys, F.sha2(F.array_join(F.transform("_s", lambda s: s["_e"]), ""), 256).alias("sha256"))


def u64_of(sha256: Column) -> Column:
    """The first eight bytes of a hex digest as an unsigned little-endian number."""
    swapped = F.concat(*[F.substring(sha256, 2 * i + 1, 2) for i in reversed(range(8))])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def hex_of_u64(sha256: Column) -> Column:
    return F.substring(sha256, 1, 16)


def wildcard_digits(text: Column) -> Column:
    """Digits masked, as addresses are."""
    return F.regexp_replace(text, "[0-9]", "?")


def mask_hex(bytes_hex: Column, places: list[int]) -> Column:
    """Bytes at the given places of a hex string replaced by ``??``."""
    out = bytes_hex
    for p in places:
        out = F.when(F.length(bytes_hex) >= 2 * p + 2, F.overlay(out, F.lit("??"), 2 * p + 1, 2)).otherwise(out)
    return out


def identity_hash(rows: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """SHA-256 of the sorted items of each key: equal for equal contents in any order."""
    items = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    return items.select(*keys, F.sha2(F.array_join("_s", "|"), 256).alias("sha256"))


def pe_header_hash(header: Column, volatile: list[tuple[int, int]]) -> Column:
    """SHA-256 of header bytes with volatile fields (offset, size) zeroed."""
    out = header
    for at, size in volatile:
        out = F.overlay(out, F.unhex(F.lit("00" * size)), at + 1, size)
    return F.sha2(out, 256)
