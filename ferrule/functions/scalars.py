"""Scalar helpers as Catalyst expressions: versions, flags, and strings in images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed bits of class and member flags, in the order in which their names are listed.
ACCESS_FLAGS = (
    ("public", 0x1),
    ("private", 0x2),
    ("protected", 0x4),
    ("static", 0x8),
    ("final", 0x10),
    ("synchronized", 0x20),
)


def version_key(version: Column) -> Column:
    """``v1.10.2`` as [1, 10, 2]; arrays of numbers compare as versions do."""
    plain = F.regexp_replace(version, "^v", "")
    return F.transform(F.split(plain, "\\."), lambda x: F.coalesce(F.regexp_extract(x, "^[0-9]+", 0).try_cast("int"), F.lit(0)))


def flag_names(flags: Column, names: tuple[tuple[str, int], ...] = ACCESS_FLAGS) -> Column:
    held = F.array(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in names])
    return F.array_join(F.array_compact(held), " ")


def ascii_length(image: Column, at: Column, most: int = 4096) -> Column:
    """Length of the NUL-terminated ASCII string at an offset of an image; 0 where there is none."""
    text = F.decode(F.substring(image, at + 1, F.lit(most + 1)), "ISO-8859-1")
    return F.length(F.regexp_extract(text, "^([\\t-\\r -~]*)\\x00", 1))


def utf16_length(image: Column, at: Column, most: int = 4096) -> Column:
    """The same for UTF-16LE text in the ASCII range, in characters."""
    text = F.decode(F.substring(image, at + 1, F.lit(2 * most + 2)), "ISO-8859-1")
    return (F.length(F.regexp_extract(text, "^((?:[\\t-\\r -~]\\x00)*)\\x00\\x00", 1)) / 2).cast("int")


def uleb128(image: Column, at: Column) -> Column:
    """Unsigned LEB128 number of up to nine bytes at an offset."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.conv(F.hex(F.substring(image, at + 1 + i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("scale"), F.lit(True).alias("open"))

    def step(acc, byte):
        return F.struct(
            F.when(acc["open"], acc["value"] + byte.bitwiseAND(F.lit(127)) * acc["scale"]).otherwise(acc["value"]).alias("value"),
            F.when(acc["open"] & (byte >= 128), acc["scale"] * 128).otherwise(acc["scale"]).alias("scale"),
            (acc["open"] & (byte >= 128)).alias("open"),
        )

    return F.aggregate(digits, start, step, lambda acc: acc["value"])


def sleb128(image: Column, at: Column, most: int = 5) -> Column:
    """Signed LEB128 number of at most 32 bits at an offset; null where it does not end."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.conv(F.hex(F.substring(image, at + 1 + i, F.lit(1))), 16, 10).cast("long"))
    ends = F.array_position(F.transform(digits, lambda b: b < 128), F.lit(True))
    held = F.slice(digits, F.lit(1), ends.cast("int"))
    value = F.aggregate(F.reverse(held), F.lit(0).cast("long"), lambda acc, b: acc * 128 + b.bitwiseAND(F.lit(127)))
    negative = (ends < most) & (F.element_at(held, -1).bitwiseAND(F.lit(64)) != 0)
    full = F.element_at(F.array(*[F.lit(1 << 7 * k) for k in range(1, most + 1)]), ends.cast("int"))
    return F.when(ends > 0, F.when(negative, value - full).otherwise(value))


def signed_hex(operands: Column) -> Column:
    """The first hexadecimal number of an operand string with the sign before it; 0 where there is none."""
    sign = F.regexp_extract(operands, r"([+-]?)\s*0x[0-9a-fA-F]+", 1)
    value = F.conv(F.regexp_extract(operands, "0x([0-9a-fA-F]+)", 1), 16, 10).cast("decimal(20,0)")
    return F.coalesce(F.when(sign == "-", -value).otherwise(value), F.lit(0).cast("decimal(21,0)"))


def report_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


#: Fixed one-letter names of primitive types.
PRIMITIVES = {
    "void": "V", "boolean": "Z", "byte": "B", "short": "S", "char": "C", "int": "I", "long": "J", "float": "F", "double": "D"
}


def dex_type_name(name: Column) -> Column:
    """Descriptors as they are, primitives by letter, dotted class names as descriptors, null for the empty name."""
    low, out = F.lower(name), name
    out = F.when(name.contains(".") & ~name.contains("/"), F.concat(F.lit("L"), F.replace(name, F.lit("."), F.lit("/")), F.lit(";"))).otherwise(out)
    for word, letter in PRIMITIVES.items():
        out = F.when(low == word, letter).otherwise(out)
    done = name.rlike("^[VZBSCIJFD]$|^\\[|^L.*;$")
    return F.when(name != "", F.when(done, name).otherwise(out))


def dex_escaped(text: Column) -> Column:
    """Backslash, quotes and control characters of a string constant escaped."""
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    marks = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[\\x00-\\x1f\\x7f]"), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(c)), 4, "0")))).otherwise(c))
    return F.array_join(marks, "")


def read_string(image: Column, at: Column, most: int = 4096) -> Column:
    """The text at an offset: NUL-terminated ASCII, else UTF-16LE of two characters or more; null where neither stands."""
    ascii_n = ascii_length(image, at, most)
    wide_n = utf16_length(image, at, most)
    first = F.decode(F.substring(image, at + 1, F.lit(1)), "ISO-8859-1").rlike("[\\t-\\r -~]")
    text = F.when(ascii_n >= 1, F.decode(F.substring(image, at + 1, ascii_n), "UTF-8"))
    text = text.when(wide_n >= 2, F.decode(F.substring(image, at + 1, 2 * wide_n), "UTF-16LE"))
    return F.when((at >= 0) & first, text)


def go_string(image: Column, base: Column, at: Column, wide: Column) -> Column:
    """The text that a pair of pointer and length at an offset names; null where either lies outside the image."""
    from ferrule.sources.binaries import uint

    pointer = F.when(wide, uint(image, at, 8).cast("decimal(20,0)")).otherwise(uint(image, at, 4).cast("decimal(20,0)"))
    length = F.when(wide, uint(image, at + 8, 8).cast("decimal(20,0)")).otherwise(uint(image, at + 4, 4).cast("decimal(20,0)"))
    place = (pointer - base).cast("int")
    text = F.decode(F.substring(image, place + 1, length.cast("int")), "UTF-8")
    return F.when((pointer >= base) & (place < F.octet_length(image)), text)


def language_map(scores: Column) -> Column:
    """Scores by language under today's names: private keys go, old names are renamed, of several scores the greatest stays."""
    named = F.transform(
        F.filter(F.map_entries(scores), lambda e: ~e["key"].startswith("_") & e["value"].isNotNull()),
        lambda e: F.struct(F.when(e["key"] == "cil", ".net").when(e["key"] == "delphi_kb_file", "delphi").otherwise(e["key"]).alias("key"), e["value"].alias("value")),
    )
    keys = F.array_distinct(F.transform(named, lambda e: e["key"]))
    best = lambda k: F.array_max(F.transform(F.filter(named, lambda e: e["key"] == k), lambda e: e["value"]))
    return F.map_from_arrays(keys, F.transform(keys, best))
