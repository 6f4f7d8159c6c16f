"""Bounds of the mask representation."""

from __future__ import annotations

#: Bits that a signed 64-bit mask holds.
MAX_ARITY = 63


def check_arity(arity: int) -> None:
    if arity > MAX_ARITY:
        raise ValueError(f"{arity} bits do not fit a mask of {MAX_ARITY}")
