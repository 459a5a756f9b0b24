"""Label cleaning, run-name parsing and result formatting as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: any Unicode white space, separator or ASCII information separator
# at either end of the text.
_OUTER_SPACE = r"(?U)^[\s\p{Z}\x1c-\x1f]+|[\s\p{Z}\x1c-\x1f]+$"

# Fixed value: how a run name carries its seed.
_RUN_NAME = r"^(.*)_seed(\d+)$"


def strip_space(col: Column) -> Column:
    """Remove Unicode white space (tab, NBSP, EM SPACE, ...) from both ends."""
    return F.regexp_replace(col.cast("string"), _OUTER_SPACE, "")


def map_flag(col: Column, mapping: Mapping[str, str]) -> Column:
    """Look the upper-cased text up in ``mapping``; anything else becomes null."""
    key = F.upper(strip_space(col))
    out = F.lit(None).cast("string")
    for source, target in mapping.items():
        out = F.when(key == source, target).otherwise(out)
    return out


def run_prefix(run: Column) -> Column:
    """Run name without its ``_seed<n>`` ending (the whole name when it has none)."""
    return F.regexp_replace(run, r"_seed\d+$", "")


def run_seed(run: Column) -> Column:
    """The seed at the end of a run name, null when it has none."""
    digits = F.regexp_extract(run, _RUN_NAME, 2)
    return F.when(digits != "", digits).cast("int")


def fixed_text(number: Column, digits: int, plus: bool = False) -> Column:
    """``number`` with ``digits`` decimals (1 to 7), rounded by the exact binary value of the double, exact ties to even.

    ``format_string`` rounds the shortest decimal that stands for the double instead, so 0.00015, which is a little less than
    that, becomes 0.0002 there and 0.0001 here.  ``plus`` puts a sign before numbers of zero and more.  Numbers that
    are not finite are ``nan``, ``inf``, ``-inf``; from 2^63 on ``format_string`` is used.
    """
    if not 1 <= digits <= 7:
        raise ValueError(f"digits must be from 1 to 7: {digits}")
    number = number.cast("double")
    size = F.abs(number)
    inside = F.when(size < 2.0**63, size).otherwise(0.0)
    whole = F.floor(inside)
    part = inside - whole.cast("double")  # exact, and under 1
    unit = 10**digits
    steps = F.floor(part * float(unit))
    # Is the part above (2 * steps + 1) / (2 * unit)?  Both halves of the part have so few bits that their products are exact;
    # near a tie so is the difference, and the sign of a sum of two doubles always is.
    spread = part * float(2**27 + 1)
    high = spread - (spread - part)
    low = part - high
    over = (high * float(2 * unit) - (steps * 2 + 1).cast("double")) + low * float(2 * unit)
    up = F.when(over > 0, 1).when(over < 0, 0).otherwise(F.pmod(steps, F.lit(2)))
    rounded = steps + up
    carried = F.floor(rounded / unit).cast("bigint")
    text = F.concat((whole + carried).cast("string"), F.lit("."), F.lpad((rounded - carried * unit).cast("string"), digits, "0"))
    special = (
        F.when(F.isnan(number), "nan")
        .when(size == float("inf"), "inf")
        .when(size >= 2.0**63, F.format_string(f"%.{digits}f", size))
    )
    # The text is always made, outside of any condition: only there does Spark compute the parts that it names so often once.
    kind = F.when(number.isNotNull(), F.when(size < 2.0**63, 0).otherwise(1))
    sign = F.when(number.cast("string").startswith("-"), "-").otherwise("+" if plus else "")
    return F.concat(sign, F.get(F.array(text, special), kind))


def mean_std_text(mean: Column, std: Column) -> Column:
    return F.concat(fixed_text(mean, 4), F.lit(" ± "), fixed_text(std, 4))


def interval_text(low: Column, high: Column) -> Column:
    """``[-0.005, +0.024]``; one sign per number."""
    return F.concat(F.lit("["), fixed_text(low, 3, True), F.lit(", "), fixed_text(high, 3, True), F.lit("]"))


def stars(p: Column) -> Column:
    """Significance marks: ``**`` under 0.01, ``*`` under 0.05."""
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
