"""Searching for a join of rule relations that restores a source."""

from __future__ import annotations

from collections import deque

import numpy as np

from maskspark.functions.kernel import natural_join
from maskspark.system import System


def search(source: System, factors: System, most_states: int | None = None) -> tuple[list[list[int]], bool]:
    """Breadth-first over joins of factors that add bits and keep rows, until the source is found or
    no state is left: the path (schemas) to the source, else of the best end state, and whether it is
    the source exactly. Best: most bits of the source, then fewest rows, then fewest joins. States can
    grow exponentially with the factors; a search that reaches most_states unfinished raises."""
    want_bits, want_rows = source.canonical().local()[0]
    pool = [(tuple(b), np.asarray(r, np.int64)) for b, r in factors.canonical().local() if set(b) <= set(want_bits) and r]
    goal = (tuple(want_bits), np.asarray(sorted(want_rows), np.int64).tobytes())
    if not pool:
        return [], False
    seen: set[tuple] = set()
    states: deque = deque()

    def reach(bits: list[int], rows: np.ndarray, path: list[list[int]]) -> None:
        if (key := (tuple(bits), rows.tobytes())) not in seen:
            if most_states is not None and len(seen) >= most_states:
                raise RuntimeError(f"the search is not finished after {most_states} states")
            seen.add(key)
            states.append((bits, rows, path))

    for b, r in pool:
        reach(list(b), r, [list(b)])
    best = None
    while states:
        bits, rows, path = states.popleft()
        if (tuple(bits), rows.tobytes()) == goal:
            return path, True
        score = (-len(bits), len(rows), len(path))
        if best is None or score < best[0]:
            best = (score, path)
        for b, r in pool:
            if set(b) - set(bits):
                joined, out = natural_join((bits, rows), (list(b), r))
                if len(out):
                    reach(joined, out, [*path, list(b)])
    return best[1], False
