"""Column expressions over row masks: bit i of a mask is the value of the table's i-th bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_at(row: Column, position: Column) -> Column:
    """0 or 1: the mask's bit at a position."""
    return F.call_function("shiftright", row, position.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def put(bit: Column, position: Column) -> Column:
    """The bit, moved to a position."""
    return F.call_function("shiftleft", bit.cast("long"), position.cast("int"))


def project(row: Column, positions: Column) -> Column:
    """The mask over the bits at the given positions, in their order."""
    return F.aggregate(F.transform(positions, lambda p, i: put(bit_at(row, p), i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def project_to(row: Column, positions: list[int]) -> Column:
    """project() for positions known now: an unrolled OR of shifts, which stays in generated code."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(positions):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(row, p).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def project_each(row: Column, targets: list[tuple[int, list[int]]]) -> Column:
    """array of (table_id, row): the mask's projections to each target's positions."""
    held = F.array(*(F.struct(F.lit(i).cast("long").alias("table_id"), F.array(*map(F.lit, at)).cast("array<int>").alias("at")) for i, at in targets))
    return F.transform(held, lambda t: F.struct(t["table_id"].alias("table_id"), project(row, t["at"]).alias("row")))


def scatter(row: Column, targets: Column) -> Column:
    """The mask whose bit targets[i] is the row's bit i; the other bits are 0."""
    return F.aggregate(F.transform(targets, lambda t, i: put(bit_at(row, i), t)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def scatter_to(row: Column, targets: list[int]) -> Column:
    """scatter() for targets known now."""
    out = F.lit(0).cast("long")
    for i, t in enumerate(targets):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(row, i).bitwiseAND(F.lit(1).cast("long")), t))
    return out


def without_bit(row: Column, position: Column) -> Column:
    """The mask with one position taken out; higher ones move down."""
    low = row.bitwiseAND(put(F.lit(1), position) - 1)
    return low.bitwiseOR(put(F.call_function("shiftright", row, (position + 1).cast("int")), position))


def positions_of(bits: Column, within: Column) -> Column:
    """The place of each of bits in within (from 0)."""
    return F.transform(bits, lambda b: (F.array_position(within, b) - 1).cast("int"))


def contains_all(within: Column, bits: Column) -> Column:
    return F.size(F.array_except(bits, within)) == 0


def is_full(row_count: Column, arity: Column) -> Column:
    """Whether the rows are all assignments of the bits; false for arities beyond a signed word."""
    return (arity < 63) & (row_count == put(F.lit(1), F.least(arity, F.lit(62))))


def rank(row_count: Column, arity: Column) -> Column:
    """rows ** (1 / arity); with no bits 1.0 for one row or more, else 0.0."""
    return F.when(arity == 0, F.when(row_count > 0, 1.0).otherwise(0.0)).otherwise(F.pow(row_count.cast("double"), F.lit(1.0) / F.greatest(arity, F.lit(1))))
