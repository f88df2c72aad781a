"""Results of many sources under one schema: the one that most of them have."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Fleet:
    """``rows`` of the sources that conform, with their name; ``apart`` has the others' own; ``status`` by name."""

    rows: DataFrame | None
    source_column: str
    apart: dict[str, DataFrame] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)


def schema_of(df: DataFrame) -> tuple[tuple[str, str], ...]:
    return tuple(df.dtypes)


def majority(schemas: Mapping[str, tuple]) -> tuple | None:
    """The commonest schema; of equally common ones the one whose first source comes first by name."""
    votes = Counter(schemas[n] for n in sorted(schemas) if schemas[n])
    return max(votes, key=lambda s: votes[s]) if votes else None  # max keeps the first of equals


def free_name(wanted: str, taken: set[str]) -> str:
    """``wanted``, with underscores before it until no column has it in any case."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def unite(sources: Mapping[str, Callable[[], DataFrame]], name: str = "source", parallel: int = 4) -> Fleet:
    """Plan all sources (in name order, ``parallel`` at a time) and unite those that have the majority's schema.

    A source that raises is ``failed: <class>``, one with another schema is ``deviates`` and is kept apart.
    """

    def plan(n: str) -> DataFrame | Exception:
        try:
            return sources[n]()
        except Exception as e:
            return e

    names = sorted(sources)
    with ThreadPoolExecutor(max(1, min(parallel, 16))) as pool:
        found = dict(zip(names, pool.map(plan, names)))
    good = {n: d for n, d in found.items() if isinstance(d, DataFrame)}
    wanted = majority({n: schema_of(d) for n, d in good.items()})
    column = free_name(name, {c for d in good.values() for c in d.columns})
    out = Fleet(None, column)
    parts = []
    for n in names:
        if n not in good:
            out.status[n] = f"failed: {type(found[n]).__name__}"
        elif schema_of(good[n]) == wanted:
            out.status[n] = "ok"
            parts.append(good[n].withColumn(column, F.lit(n)))
        else:
            out.status[n] = "deviates"
            out.apart[n] = good[n]
    out.rows = reduce(DataFrame.unionByName, parts) if parts else None
    return out
