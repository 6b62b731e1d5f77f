"""Row comparison with tolerance for doubles."""

from __future__ import annotations

import math


def _key(value):
    if value is None:
        return (0, "")
    return (1, f"{value:.4f}" if isinstance(value, float) else str(value))


def same_rows(left, right, columns: list[str]) -> None:
    """Both, frames or lists of dicts, hold the same rows in ``columns``, in any order."""

    def rows(side) -> list[tuple]:
        return [tuple(r[c] for c in columns) for r in (side if isinstance(side, list) else side.select(*columns).collect())]

    a, b = (sorted(rows(side), key=lambda row: [_key(v) for v in row]) for side in (left, right))
    assert len(a) == len(b), f"{len(a)} rows, expected {len(b)}"
    for found, expected in zip(a, b):
        for x, y in zip(found, expected):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (found, expected)
            else:
                assert x == y, (found, expected)
