"""Position-independent forms of instructions, as expressions over rows of (bytes, mnemonic, operands).

``bytes`` are lower-case hex. Escaped places become ``?``. Groups of mnemonics and the formats of opcodes are tables
that the caller joins, so no list of any instruction set stands here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.refs import base_mnemonic

#: Fixed order in which groups of mnemonics are tried, and the letter of mnemonics in none.
GROUPS, NO_GROUP = "ACMSPYFXVN", "U"

#: Fixed names of x86 registers, by rule: legacy ones in all widths, numbered ones, and the other classes as patterns.
_LEGACY = "[re]?(?:ax|bx|cx|dx|si|di|bp|sp|ip)|[abcd][hl]|(?:si|di|bp|sp)l|r(?:8|9|1[0-5])[dwb]?"
X86_CLASSES = (
    ("REG", f"^(?:{_LEGACY})$"),
    ("SREG", "^[cdefgs]s$"),
    ("XREG", "^[xy]mm[0-9]+$|zmm[0-9]+"),
    ("CREG", "^[cd]r[0-9]+$"),
    ("FREG", "^st"),
    ("MMREG", "^mm"),
)
X86_POINTER = r"^(?:(?:[xyz]mmword|xword|tbyte|[qd]?word|byte) ptr|ptr|\[)"
X86_CONSTANT = "^[+-]?(?:0[xX])?[0-9a-fA-F]+$|:"
#: Fixed opcodes (hex, prefixes left out) of transfers, with the hex digits at the end that hold a target.
X86_TRANSFERS = (("^(?:e8|e9)", 8), ("^ff(?:14|15|24|25|aa)(?=.{6})", 8), ("^48ff25", 8), ("^48ff61..$", 2), ("^(?:ea|9a)", 12))
X86_INNER = (("^(?:7|e[0123]|eb)", 2), ("^0f8", 8))
X86_PREFIXES = "^(?:26|2e|36|3e|64|65|66|67|f0|f2|f3)+(?=..)"
CALL_JUMP = "^(?:l?call|l?jmp|j[a-z]{1,5}|loop[a-z]*)$"

#: Fixed bytes (from 0) that hold immediates, indexes and offsets, by instruction format.
DALVIK_MASKS = {
    "10x": "", "10t": "1", "11n": "1", "11x": "", "12x": "", "20t": "2 3", "21c": "2 3", "21h": "2 3", "21s": "2 3", "21t": "2 3",
    "22b": "3", "22c": "2 3", "22s": "2 3", "22t": "2 3", "22x": "", "23x": "", "30t": "2 3 4 5", "31c": "2 3 4 5", "31i": "2 3 4 5",
    "31t": "2 3 4 5", "32x": "", "35c": "2 3", "3rc": "2 3", "45cc": "2 3 6 7", "4rcc": "2 3 6 7", "51l": "2 3 4 5 6 7 8 9",
}


def wild(n: Column | int) -> Column:
    return F.repeat(F.lit("?"), n if isinstance(n, Column) else F.lit(n))


def tail_masked(code: Column, digits: int) -> Column:
    """The last hex digits of an instruction masked."""
    return F.concat(F.substring(code, F.lit(1), F.greatest(F.length(code) - digits, F.lit(0))), wild(digits))


def mnemonic_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``grp``, by a table of (name, grp); of several groups the first in order of trial wins."""
    place = F.instr(F.lit(GROUPS), F.col("grp"))
    ranked = groups.groupBy("name").agg(F.min_by("grp", place).alias("grp"))
    return rows.withColumn("name", base_mnemonic(F.col("mnemonic"))).join(ranked, "name", "left").withColumn("grp", F.coalesce("grp", F.lit(NO_GROUP))).drop("name")


def x86_field(field: Column, registers: bool = True, constants: bool = True) -> Column:
    """The class of one operand; later rules win: constants over pointers over registers."""
    field = F.trim(field)
    named = F.lit(None).cast("string")
    if registers:
        named = F.coalesce(*[F.when(field.rlike(pattern), name) for name, pattern in X86_CLASSES])
    named = F.when(field.rlike(X86_POINTER), "PTR").otherwise(named)
    if constants:
        named = F.when((field != "") & field.rlike(X86_CONSTANT), "CONST").otherwise(named)
    return F.coalesce(named, field)


def x86_operands(operands: Column, mnemonic: Column, offsets_only: bool = False) -> Column:
    """The classes of all operands, comma-separated; with ``offsets_only`` jumps are OFFSET and only pointers are classed."""
    kept = not offsets_only
    out = F.array_join(F.transform(F.split(operands, ","), lambda f: x86_field(f, kept, kept)), ", ")
    return F.when(base_mnemonic(mnemonic).rlike(CALL_JUMP), "OFFSET").otherwise(out) if offsets_only else out


def x86_transfer(code: Column, inner: bool = False) -> Column:
    """Targets of calls and jumps masked; those of jumps inside a function only with ``inner``."""
    plain = F.regexp_replace(code, X86_PREFIXES, "")
    out = None
    for pattern, digits in (X86_INNER if inner else ()) + X86_TRANSFERS:
        masked = tail_masked(code, digits)
        out = F.when(plain.rlike(pattern), masked) if out is None else out.when(plain.rlike(pattern), masked)
    return out.otherwise(code)


def little_endian(value: Column, size: int) -> Column:
    """Lower-case hex of a number's low bytes, least first."""
    return _swapped(F.hex(value), size)


def _swapped(digits: Column, size: int) -> Column:
    """The same from at most 16 hex digits, so that numbers need not fit a long."""
    digits = F.lower(F.lpad(digits, 16, "0"))
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)])


def _counted(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def _address(digits: Column) -> Column:
    """The bytes of an address of up to 16 digits: four where it fits them, else eight."""
    return F.when(_number(digits) < 1 << 32, _swapped(digits, 4)).otherwise(_swapped(digits, 8))


def x86_references(code: Column, operands: Column) -> Column:
    """A 32-bit displacement that stands alone in brackets or beside rip, masked; of two places only the last."""
    sign = F.regexp_extract(operands, r"\[(?:rip ([+-]) )?0x[0-9a-fA-F]+\]", 1)
    digits = F.regexp_extract(operands, r"\[(?:rip [+-] )?0x([0-9a-fA-F]{1,16})\]", 1)
    back = F.when(sign == "-", little_endian(F.lit(1 << 32) - F.conv(digits, 16, 10).try_cast("long"), 4))
    part = F.when(digits != "", F.coalesce(back, _address(digits)))
    n, places = _counted(code, part), F.length(part)
    last = F.length(code) - F.instr(F.reverse(code), F.reverse(part)) - places + 2
    return F.when(n.isin(1, 2), F.overlay(code, wild(places), last, places)).otherwise(code)


def x86_values(code: Column, operands: Column, low: Column, high: Column) -> Column:
    """Immediates that are addresses of the image, masked where they stand once or twice; small bases are not trusted."""
    found = F.regexp_extract_all(operands, F.lit("0x([0-9a-fA-F]{1,16})"), F.lit(1))
    inside = F.filter(found, lambda d: (low > 0x100000) & (_number(d) >= low) & (_number(d) < high))

    def mask(acc, d):
        part = _address(d)
        return F.when(_counted(acc, part).isin(1, 2), F.replace(acc, part, wild(F.length(part)))).otherwise(acc)

    return F.aggregate(inside, code, mask)


def x86_binary(code: Column, mnemonic: Column, operands: Column, low: Column | None = None, high: Column | None = None, inner: bool = False) -> Column:
    """Escaped bytes of an x86 instruction: transfers by opcode, others by references and, in an image, by values."""
    out = F.when(operands.rlike(r"ptr \[0x|\[rip [+-] 0x"), x86_references(code, operands)).otherwise(code)
    if low is not None and high is not None:
        out = F.when(operands.rlike("^0x|, 0x|[+-] 0x"), x86_values(out, operands, low, high)).otherwise(out)
    return F.when(base_mnemonic(mnemonic).rlike(CALL_JUMP), x86_transfer(code, inner)).otherwise(out)


def a64_binary(code: Column, mask: Column) -> Column:
    """A word's hex with the nibbles that ``mask`` (eight hex digits, f keeps, 0 masks) does not keep as ``?``."""
    pairs = F.zip_with(F.split(code, ""), F.split(mask, ""), lambda c, m: F.when(m == "0", "?").otherwise(c))
    return F.array_join(pairs, "")


def cil_opcode_only(code: Column) -> Column:
    size = F.when(code.startswith("fe"), 4).otherwise(2)
    return F.concat(F.substring(code, F.lit(1), size), wild(F.greatest(F.length(code) - size, F.lit(0))))


def cil_binary(code: Column, kind: Column, inner: bool = False) -> Column:
    """``kind`` of the operand: of tokens only opcode and table stay; of branches, with ``inner``, only the opcode."""
    size = F.when(code.startswith("fe"), 4).otherwise(2)
    token = F.concat(F.substring(code, F.lit(1), size), wild(F.greatest(F.length(code) - size - 2, F.lit(0))), F.substring(code, -2, 2))
    token = F.when(F.length(code) >= size + 8, token).otherwise(code)
    branch = cil_opcode_only(code) if inner else code
    return F.when(kind == "token", token).when(kind == "branch", branch).otherwise(code)


def dalvik_binary(code: Column, form: Column) -> Column:
    """Bytes masked by the instruction's format; of an unknown format only the opcode stays."""
    out = None
    for name, places in DALVIK_MASKS.items():
        masked = code
        for p in map(int, places.split()):
            masked = F.when(F.length(code) >= 2 * p + 2, F.overlay(masked, F.lit("??"), 2 * p + 1, 2)).otherwise(masked)
        out = F.when(form == name, masked) if out is None else out.when(form == name, masked)
    return out.otherwise(F.concat(F.substring(code, 1, 2), wild(F.greatest(F.length(code) - 2, F.lit(0)))))


def with_escapes(rows: DataFrame, architecture: Column, **image: Column) -> DataFrame:
    """``rows`` with ``escaped`` by architecture; of unknown ones the raw bytes. Needs ``form`` (Dalvik), ``kind`` (CIL), ``mask`` (AArch64)."""
    code = F.col("bytes")
    by_name = {
        "intel": x86_binary(code, F.col("mnemonic"), F.col("operands"), image.get("low"), image.get("high")),
        "aarch64": a64_binary(code, F.col("mask")),
        "cil": cil_binary(code, F.col("kind")),
        "dalvik": dalvik_binary(code, F.col("form")),
    }
    out = F.lit(None).cast("string")
    for name, value in by_name.items():
        out = F.when(architecture == name, value).otherwise(out)
    return rows.withColumn("escaped", F.coalesce(out, code))
