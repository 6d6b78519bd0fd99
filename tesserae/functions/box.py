"""Axis-aligned box expressions. A box is six columns: <prefix>lx, ly, lz, hx, hy, hz."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Labels of the room's shell, which take part in no relation.
STRUCTURE = ("wall", "floor", "ceiling")
#: Fixed values of the relations, in metres and shares.
NEAR, MAX_SIDE = 0.25, 3.0
FOOTPRINT, LIFT, SINK, DROP = 0.5, 0.05, 0.1, 0.75


def side(p: str, axis: str) -> Column:
    return F.col(f"{p}h{axis}") - F.col(f"{p}l{axis}")


def product(columns) -> Column:
    return reduce(lambda a, b: a * b, columns)


def volume(p: str) -> Column:
    """Product of the sides, none below 0."""
    return product(F.greatest(side(p, k), F.lit(0.0)) for k in AXES)


def centre(p: str, axis: str) -> Column:
    return (F.col(f"{p}l{axis}") + F.col(f"{p}h{axis}")) / 2


def finite(p: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{p}{e}{k}").isNotNull() for e in "lh" for k in AXES))


def _square_root_of_sum(parts) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (x * x for x in parts)))


def gap(a: str, b: str) -> Column:
    """Distance between two boxes, 0 where they touch."""
    return _square_root_of_sum(
        F.greatest(F.col(f"{a}l{k}") - F.col(f"{b}h{k}"), F.col(f"{b}l{k}") - F.col(f"{a}h{k}"), F.lit(0.0)) for k in AXES
    )


def centre_distance(a: str, b: str) -> Column:
    return _square_root_of_sum(centre(a, k) - centre(b, k) for k in AXES)


def point_distance(p: str, point: tuple[float, float, float]) -> Column:
    """Distance of a point to a box, 0 inside."""
    return _square_root_of_sum(
        F.greatest(F.col(f"{p}l{k}") - F.lit(float(v)), F.lit(float(v)) - F.col(f"{p}h{k}"), F.lit(0.0))
        for k, v in zip(AXES, point, strict=True)
    )


def overlap(a: str, b: str, axes=AXES) -> Column:
    return product(
        F.greatest(
            F.least(F.col(f"{a}h{k}"), F.col(f"{b}h{k}")) - F.greatest(F.col(f"{a}l{k}"), F.col(f"{b}l{k}")), F.lit(0.0)
        )
        for k in axes
    )


def containment(a: str, b: str) -> Column:
    """Shared volume over the smaller volume; 0 where that is empty."""
    smaller = F.least(volume(a), volume(b))
    return F.when(smaller > 0, overlap(a, b) / F.when(smaller > 0, smaller)).otherwise(0.0)


def inside(part: str, whole: str) -> Column:
    """Share of one box inside the other, directional."""
    return overlap(part, whole) / F.greatest(product(side(part, k) for k in AXES), F.lit(1e-9))


def takes_part(p: str, label: Column) -> Column:
    """Boxes that may have relations: no shell, finite, no side over the limit."""
    return ~label.isin(*STRUCTURE) & finite(p) & (F.greatest(*(side(p, k) for k in AXES)) <= MAX_SIDE)


def rests_on(a: str, b: str) -> Column:
    """Whether box a stands on or in box b."""
    area = F.greatest(side(a, "x") * side(a, "y"), F.lit(1e-6))
    bottom, low, top = F.col(f"{a}lz"), F.col(f"{b}lz"), F.col(f"{b}hz")
    return (
        (overlap(a, b, ("x", "y")) / area >= FOOTPRINT)
        & (bottom >= low + LIFT)
        & (bottom <= top + SINK)
        & (bottom >= top - DROP)
        & (product(side(a, k) for k in AXES) < product(side(b, k) for k in AXES))
    )
