"""Ordered folds: one streaming pass a key, whatever its length.

Rows are dealt by key and sorted inside the partitions, and a task walks them
batch by batch, carrying a small state from row to row. A key is a chain, so
its rows meet in one task by nature; they are never gathered, only passed.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame

from ringside.shipping import ship


def fold(df: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``step(state, rows)`` for the rows of each key in order, in one or more
    pieces; ``start()`` makes a key's state. Results are laid end to end."""

    def run(batches):
        at, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf[keys].astype(object).where(pdf[keys].notna(), None)
            new = (ids != ids.shift()).any(axis=1).to_numpy()
            new[0] = True
            begins = [i for i, x in enumerate(new) if x]
            for lo, hi in zip(begins, [*begins[1:], len(pdf)]):
                key = tuple(ids.iloc[lo])
                if state is None or key != at:
                    at, state = key, start()
                yield step(state, pdf.iloc[lo:hi])

    ship(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
