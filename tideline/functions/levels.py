"""Ordered domains: a level list gives each label an ordinal; labels outside it are missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level orders of the study.
OUTCOME = ["Survived", "Succumbed"]
ARM = ["27.5", "10", "1", "0.1"]
STAGE = ["Baseline", "Early", "Middle", "Late", "Recovered"]
GROUP = ["HD", "LD-V", "LD-NV"]
REGULATION = ["Up", "None", "Down"]


def _lookup(c: Column, pairs: Mapping) -> Column:
    if not pairs:
        raise ValueError("a level list must not be empty")
    flat = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.when(c.isNotNull(), F.try_element_at(F.create_map(*flat), c))


def level_rank(c: Column, levels: Sequence[str]) -> Column:
    """1-based ordinal of a label; missing when the label is not a level."""
    return _lookup(c, {level: i + 1 for i, level in enumerate(levels)}).cast("int")


def as_level(c: Column, levels: Sequence[str]) -> Column:
    """The label itself, or missing when it is not a level."""
    return F.when(c.isin(list(levels)), c)


def relevel(levels: Sequence[str], first: str) -> list[str]:
    """The level list with one level moved to the front."""
    if first not in levels:
        raise ValueError(f"{first!r} is not a level")
    return [first, *[x for x in levels if x != first]]


def relabel(c: Column, labels: Mapping[str, str]) -> Column:
    """Map levels to labels; two levels may share a label; others become missing."""
    return _lookup(c, labels)
