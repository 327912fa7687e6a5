"""Character spans of regular expression matches, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = 64


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def match_columns(name: str, text: Column, pattern: str, guard: Column, group: int | None = None) -> dict[str, Column]:
    """First step: lengths of the matches and of what lies between them. Texts that fail
    ``guard``, a cheap test that every match passes, are not searched."""
    none = F.array().cast("array<int>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    columns = {f"{name}_m": F.when(guard, F.transform(found, F.length)).otherwise(none),
               f"{name}_s": F.when(guard, F.transform(F.split(text, pattern, -1), F.length)).otherwise(none)}
    if group is not None:
        columns[f"{name}_g"] = F.when(guard, F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)).otherwise(none)
    return columns


def step_columns(name: str) -> dict[str, Column]:
    """Second step: lengths of gap and match together, and their sums up to every 64th."""
    both = F.zip_with(F.slice(f"{name}_s", 1, F.size(f"{name}_m")), F.col(f"{name}_m"), lambda a, b: a + b)
    return {f"{name}_b": both}


def block_columns(name: str) -> dict[str, Column]:
    """Third step: the sums before each run of 64, so that no prefix sum is long."""
    b, n = F.col(f"{name}_b"), F.size(f"{name}_b")
    runs = F.transform(F.sequence(F.lit(0), F.ceil(n / _STEP).cast("int")), lambda i: _total(F.slice(b, i * _STEP + 1, _STEP)))
    return {f"{name}_r": F.when(n > 0, runs).otherwise(F.array().cast("array<int>"))}


def prefix_columns(name: str) -> dict[str, Column]:
    """Fourth step: (start, end) of every match in code points, end exclusive."""
    b, m, s, r = (F.col(f"{name}_{k}") for k in "bmsr")

    def span(length: Column, i: Column) -> Column:
        run = F.floor(i / _STEP).cast("int")
        start = _total(F.slice(r, 1, run)) + _total(F.slice(b, run * _STEP + 1, i - run * _STEP)) + F.get(s, i)
        return F.struct(start.alias("start"), (start + length).alias("end"))

    return {f"{name}_at": F.transform(m, span)}
