"""Scalar and array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def jaccard_of_counts(common: Column, n: Column, m: Column) -> Column:
    """Jaccard similarity from set sizes; 0 if both are empty."""
    union = n + m - common
    return F.when(union == 0, F.lit(0.0)).otherwise(common / union)


def counts_alike(n: Column, m: Column) -> Column:
    """The cheap gate on callee counts: rejects pairs far apart."""
    a, b = F.greatest(n, m), F.least(n, m)
    return F.when(b == 0, a <= 3).otherwise(~((a > 2 * b) & (a - b > 3)))


def in_ranges(value: Column, ranges: Column) -> Column:
    """Whether value lies in any half-open range of an array of struct(lo, hi)."""
    return F.exists(ranges, lambda r: (value >= r["lo"]) & (value < r["hi"]))


def classified(value: Column, classes: Sequence[tuple[str, Sequence[tuple[float, float]]]], default: Column | None = None) -> Column:
    """The first class, in order of precedence, one of whose half-open ranges holds the value."""
    out = F.lit(None).cast("string") if default is None else default
    for name, ranges in reversed(classes):
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | ((value >= lo) & (value < hi))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def pointer_kind(value: Column, width: Column, pointer_bits: int, executable: Sequence[tuple[int, int]], data: Sequence[tuple[int, int]], objects: Sequence[tuple[int, int]], recorded: Column) -> Column:
    """What a constant is: exec, data, object or stack pointer, in this order, or a constant.

    Only constants of pointer width can be pointers; a stack pointer is one of the recorded memory addresses (an array).
    """
    places = classified(value, [("exec", executable), ("data", data), ("object", objects)], F.when(F.array_contains(recorded, value), F.lit("stack")).otherwise(F.lit("constant")))
    return F.when(width == pointer_bits, places).otherwise(F.lit("constant"))


def from_hex(text: Column) -> Column:
    """An address written as hexadecimal, with or without 0x; up to 64 bits, so a decimal."""
    return F.conv(F.regexp_extract(text, r"(?i)^\s*(?:0x)?([0-9a-f]+)\s*$", 1), 16, 10).cast("decimal(20,0)")


def to_hex(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.conv(value.cast("string"), 10, 16)))


def symbol_name(text: Column) -> Column:
    """The base name of a symbol written ``kind_name_id_bits``."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^(?:reg|mem)_(.+?)_.*$", 1), F.lit("")), text)


def exclusive_or(a: Column, b: Column) -> Column:
    return (a & ~b) | (b & ~a)


def is_call(mnemonic: Column) -> Column:
    """Call instructions of the supported architectures."""
    m = F.lower(F.trim(mnemonic))
    return m.startswith("call") | m.isin("bl", "blr")


def is_return(mnemonic: Column) -> Column:
    return F.lower(F.trim(mnemonic)).startswith("ret")


def is_conditional_jump(mnemonic: Column) -> Column:
    m = F.lower(F.trim(mnemonic))
    return (m.startswith("j") & (m != "jmp")) | m.startswith("b.") | m.isin("cbz", "cbnz", "tbz", "tbnz")


def is_boundary(mnemonic: Column) -> Column:
    """Instructions that end a segment: calls and returns."""
    return is_call(mnemonic) | is_return(mnemonic)


def contains_boundary(path: Column) -> Column:
    """Whether any instruction of a path (array of mnemonics) is a boundary."""
    return F.exists(path, is_boundary)


def repeats_its_tail(trace: Column, unit: int, bound: int) -> Column:
    """Whether the last ``unit`` entries of a trace stand there ``bound`` times in a row."""
    tail = F.slice(trace, -unit, unit)
    whole = F.lit(True)
    for k in range(2, bound + 1):
        whole = whole & (F.slice(trace, -unit * k, unit) == tail)
    return F.when(F.size(trace) >= unit * bound, whole).otherwise(F.lit(False))
