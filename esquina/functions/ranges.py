"""House-number ranges: ordered bounds, position, and range pieces for equi-joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outermost house numbers.
LOWEST, HIGHEST = 0, 999_999

# Pieces are blocks of 16**level numbers.
BITS = 4
LEVELS = 6
ANY_NUMBER = -1


def lower_bound(first: Column, last: Column) -> Column:
    return F.greatest(F.least(first, last), F.lit(LOWEST)).cast("int")


def upper_bound(first: Column, last: Column) -> Column:
    return F.least(F.greatest(first, last), F.lit(HIGHEST)).cast("int")


def position(number: Column, low: Column, high: Column) -> Column:
    """Share of the range before ``number``; the middle when there is only one number."""
    held = F.least(F.greatest(number.cast("long"), low), high)
    return F.when(low == high, F.lit(0.5)).otherwise((held - low) / F.nullif(high - low, F.lit(0)))


def is_even(number: Column) -> Column:
    return F.coalesce(number % 2 == 0, F.lit(False))


def _piece(level: int, block: str) -> str:
    return f"named_struct('level', {level}, 'block', CAST({block} AS BIGINT))"


def pieces_of_range(low: str, high: str, with_any: bool = False) -> Column:
    """The blocks that exactly tile the range between two bigint columns.

    At most 30 per level; only the top level can hold more, and only for ranges beyond
    16 million numbers. ``with_any`` adds the piece that stands for any number.
    """

    def first(level: int) -> str:
        return f"shiftright({low} + {(1 << BITS * level) - 1}L, {BITS * level})"

    def last(level: int) -> str:
        return f"(shiftright({high} + 1L, {BITS * level}) - 1L)"

    def run(level: int, start: str, stop: str) -> str:
        blocks = f"IF({start} <= {stop}, sequence({start}, {stop}), CAST(array() AS ARRAY<BIGINT>))"
        return f"transform({blocks}, b -> {_piece(level, 'b')})"

    runs = []
    for level in range(LEVELS - 1):
        up_first, up_last = first(level + 1), last(level + 1)
        split = f"{up_first} <= {up_last}"
        # The blocks before and after those that the next level covers.
        runs.append(run(level, first(level), f"IF({split}, {up_first} * {1 << BITS} - 1L, {last(level)})"))
        runs.append(run(level, f"IF({split}, (1L + {up_last}) * {1 << BITS}, 1L + {last(level)})", last(level)))
    top = LEVELS - 1
    runs.append(run(top, first(top), last(top)))
    if with_any:
        runs.append(f"array({_piece(ANY_NUMBER, '0')})")
    return F.expr(f"concat({', '.join(runs)})")


def pieces_of_number(number: str, any_if: str | None = None) -> Column:
    """The blocks that hold the number, one per level; none for a null number.

    Where the column ``any_if`` is true, the piece that stands for any number is added.
    """
    held = ", ".join(_piece(lv, f"shiftright(CAST({number} AS BIGINT), {BITS * lv})") for lv in range(LEVELS))
    none = "CAST(array() AS ARRAY<STRUCT<level: INT, block: BIGINT>>)"
    extra = f"IF({any_if}, array({_piece(ANY_NUMBER, '0')}), {none})" if any_if else none
    return F.expr(f"concat(IF({number} IS NULL, {none}, array({held})), {extra})")
