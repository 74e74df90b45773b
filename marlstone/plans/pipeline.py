"""A pipeline is a list of {operator: parameters}, folded over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.dedup import minhash_dedup
from marlstone.session import spread

MAPPERS: dict[str, Callable[[Column], Column]] = {
    "clean_html": T.clean_html, "clean_links": T.clean_links, "clean_email": T.clean_email, "normalize_whitespace": T.normalize_whitespace, "fix_unicode": T.fix_unicode, "fix_mojibake": T.fix_mojibake,
}
FILTERS: dict[str, Callable[..., Column]] = {
    "text_length": lambda c, min_len=50, max_len=10_000: T.length_between(c, min_len, max_len),
    "alphanumeric": lambda c, min_ratio=0.6, max_ratio=0.95: _holds(T.alnum_ratio(c), min_ratio, max_ratio),
    "special_characters": lambda c, min_ratio=0.0, max_ratio=0.25: _holds(T.special_ratio(c), min_ratio, max_ratio),
    "character_repetition": lambda c, rep_len=10, max_ratio=0.5: T.char_repetition(c, rep_len) <= max_ratio,
}
#: Cleaning, then filters, then near-duplicate removal.
DEFAULT = [
    {"clean_html": {}}, {"clean_links": {}}, {"clean_email": {}}, {"normalize_whitespace": {}}, {"fix_unicode": {}}, {"text_length": {}}, {"alphanumeric": {}}, {"special_characters": {}}, {"character_repetition": {}},
    {"minhash_dedup": {"window": 5, "threshold": 0.7, "permutations": 256}},
]


def _once(c: Column) -> Column:
    """`c` as it is, but computed where it stands: filters behind it are not moved
    before it, which would compute it once more for each of them."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _holds(ratio: Column, low: float, high: float) -> Column:
    """low <= ratio <= high with the ratio computed once."""
    return F.exists(F.array(ratio), lambda r: r.between(low, high))


def run(df: DataFrame, steps: list[dict[str, dict]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Apply the steps in order. Unknown names raise before anything runs."""
    for step in steps:
        for name in step:
            if name not in MAPPERS and name not in FILTERS and name != "minhash_dedup":
                raise ValueError(f"unknown operator {name!r}")
    df, mapped = spread(df), False
    for step in steps:
        for name, params in step.items():
            if name in MAPPERS:
                df, mapped = df.withColumn(text, MAPPERS[name](F.col(text), **params)), True
            elif name in FILTERS:
                df, mapped = df.withColumn(text, _once(F.col(text))) if mapped else df, False
                df = df.where(FILTERS[name](F.col(text), **params))
            else:
                df = minhash_dedup(df, key, text, **params)
    return df
