"""Ordered walks over groups.

``ordered_walk`` streams the sorted rows of each key past a small state, so a key of any
length needs one pass and no more memory than its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.lineage import fan_out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside a lambda."""
    return F.transform(F.array(value), body)[0]


class Walker(Protocol):
    """State of one key; both methods return finished output rows as tuples."""

    def take(self, rows: dict[str, np.ndarray]) -> list[tuple]: ...

    def close(self) -> list[tuple]: ...


def edges(columns: dict[str, np.ndarray], names: list[str], size: int) -> list[int]:
    """Places where a run of equal values of ``names`` begins, and the end."""
    new = np.zeros(size, bool)
    for name in names:
        new[1:] |= columns[name][1:] != columns[name][:-1]
    return [0, *np.flatnonzero(new).tolist(), size]


def ordered_walk(
    df: DataFrame, keys: list[str], order: list[Column], start: Callable[[tuple], Walker], schema: str
) -> DataFrame:
    """Walk the rows of every key in order; ``start(key)`` makes the state of a key.

    A walker gets the rows of its key in pieces, cut wherever an Arrow batch ends.  ``keys`` and the columns that a walker
    reads as numbers must not be null, and ``order`` must be total for results that do not depend on the plan.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        walker: Walker | None = None
        for pdf in batches:
            out: list[tuple] = []
            columns = {c: pdf[c].to_numpy() for c in pdf.columns}
            cuts = edges(columns, keys, len(pdf))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                here = tuple(columns[k][low] for k in keys)
                if walker is None or here != key:
                    if walker is not None:
                        out += walker.close()
                    key, walker = here, start(here)
                out += walker.take({c: v[low:high] for c, v in columns.items()})
            if out:
                yield pd.DataFrame.from_records(out, columns=names)
        if walker is not None and (out := walker.close()):
            yield pd.DataFrame.from_records(out, columns=names)

    sorted_rows = fan_out(df, *keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInPandas(run, schema)
