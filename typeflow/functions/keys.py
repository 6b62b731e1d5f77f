"""Categories of raw key records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key codes per category (inclusive ranges). The first category that matches wins.
SPACE_CODES = (49,)
ENTER_CODES = (36, 76)
ALPHANUMERIC_RANGES = (
    (0, 9),
    (11, 28),
    (31, 50),
    (65, 65),
    (67, 67),
    (69, 69),
    (75, 75),
    (78, 78),
    (81, 92),
    (96, 103),
    (105, 107),
    (109, 109),
    (111, 117),
    (119, 126),
)


def key_category(kind: Column, keycode: Column) -> Column:
    """Space, Enter, Alphanumeric or Other for key presses, Modifier for flag changes, Other for the rest."""
    in_ranges = F.lit(False)
    for low, high in ALPHANUMERIC_RANGES:
        in_ranges = in_ranges | keycode.between(low, high)
    pressed = (
        F.when(keycode.isin(*SPACE_CODES), "Space")
        .when(keycode.isin(*ENTER_CODES), "Enter")
        .when(in_ranges, "Alphanumeric")
        .otherwise("Other")
    )
    return F.when(kind == "keyDown", pressed).when(kind == "flagsChanged", "Modifier").otherwise("Other")
