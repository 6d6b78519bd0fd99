"""Colours of objects: bright, light enough for black text, fixed by the number alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Darkest channel, and how many steps lie above it.
DARKEST, STEPS = 90, 166
#: Odd multipliers that spread consecutive numbers over each channel.
SPREAD = (40503, 30011, 52711)


def channels(number: Column, seed: int = 0) -> list[Column]:
    """Red, green and blue from 90 to 255."""
    key = number.cast("bigint") + seed * 7919 + 1
    return [(F.pmod(key * m + F.floor(key * m / 256), F.lit(STEPS)) + DARKEST).cast("int") for m in SPREAD]
