"""Text helpers for labels, units and p-values, all as built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Significance marks and their upper bounds.
STARS = [(0.0001, "****"), (0.001, "***"), (0.01, "**"), (0.05, "*")]
# Fold-change arrows, (lower bound, mark), and the bound of the down arrow.
UP_ARROWS = [(2, "↑"), (5, "↑↑"), (10, "↑↑↑"), (20, "↑↑↑↑")]
DOWN_ARROW = (0.5, "↓")


def _tail(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.length(c))


def sentence_case(c: Column) -> Column:
    """First letter upper, all the rest lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(_tail(c)))


def cap_first(c: Column) -> Column:
    """First letter upper, the rest untouched."""
    return F.concat(F.upper(F.left(c, F.lit(1))), _tail(c))


def str_remove(c: Column, pattern: str) -> Column:
    """Drop the first match of ``pattern``."""
    return str_replace(c, pattern, "")


def str_replace(c: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match; the replacement is literal text."""
    start = F.regexp_instr(c, F.lit(pattern))
    hit = F.regexp_substr(c, F.lit(pattern))
    after = F.substring(c, start + F.length(hit), F.length(c))
    return F.when(start > 0, F.concat(F.substring(c, F.lit(1), start - 1), F.lit(replacement), after)).otherwise(c)


def str_extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match (or its group), missing when nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def percent_label(name: str, share: Column) -> Column:
    """``PC1 (37%)``; whole percent, halves to even."""
    return F.concat(F.lit(f"{name} ("), F.bround(100 * share, 0).cast("int").cast("string"), F.lit("%)"))


def step_label(ratio: Column) -> Column:
    """Arrows for a fold change; a later (higher) step replaces an earlier one, down wins last."""
    out = F.when(ratio <= DOWN_ARROW[0], F.lit(DOWN_ARROW[1]))
    for bound, mark in sorted(UP_ARROWS, reverse=True):
        out = out.when(ratio >= bound, F.lit(mark))
    return out


def stars(p: Column) -> Column:
    """Significance marks of a p-value; missing stays missing."""
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for bound, mark in STARS:
        out = out.when(p <= bound, F.lit(mark))
    return out.otherwise(F.lit("ns"))


def p_text(p: Column, digits: int = 1, eps: float = 2.220446049250313e-16) -> Column:
    """``p=0.03`` with ``digits`` significant digits, scientific where that is shorter."""
    exponent = F.floor(F.log10(p)).cast("int")
    scale = F.pow(F.lit(10.0), (exponent - (digits - 1)).cast("double"))
    rounded = F.round(p / scale, 0) * scale
    exponent2 = F.floor(F.log10(rounded) + F.lit(1e-9)).cast("int")
    mantissa = rounded / F.pow(F.lit(10.0), exponent2.cast("double"))
    sci = F.concat(
        F.format_number(mantissa, digits - 1),
        F.lit("e-"),
        F.lpad(F.abs(exponent2).cast("string"), 2, "0"),
    )
    fixed = F.regexp_replace(F.rtrim(rounded.cast("decimal(22,10)").cast("string"), F.lit("0")), r"\.$", "")
    small = f"<{eps:.1g}"
    return F.concat(
        F.lit("p="),
        F.when(p < eps, F.lit(small)).when(exponent2 < (-3 if digits == 1 else -4), sci).otherwise(fixed),
    )
