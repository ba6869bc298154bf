"""Aggregates in Python of two phases: buffers made where the rows are, merged by key.

Each task folds its rows into one buffer a group, so the shuffle carries a buffer for each group and task, and a group of
any size is never brought together.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Aggregate(ABC):
    """``kind``: the result's Spark type. Buffers are any value that can be pickled; ``merge`` doesn't mind order."""

    kind: str

    @abstractmethod
    def update(self, buffer, rows: pd.DataFrame): ...

    @abstractmethod
    def merge(self, a, b): ...

    @abstractmethod
    def finish(self, buffer): ...


def aggregate(df: DataFrame, by: list[str], columns: list[str], f: Aggregate, out: str) -> DataFrame:
    """by.., out. Null keys are groups. A task whose groups are more than ``GROUPS`` hands its buffers on and starts anew."""
    kinds = {field.name: field.dataType.simpleString() for field in df.schema.fields}
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in by)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}

        def flush() -> pd.DataFrame:
            rows = pd.DataFrame([*held], columns=by, dtype=object)
            rows["buffer"] = [pickle.dumps(b) for b in held.values()]
            held.clear()
            return rows

        for frame in frames:
            for key, rows in frame.groupby(by, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = f.update(held.get(key), rows[columns])
            if len(held) >= GROUPS:
                yield flush()
        if held:
            yield flush()

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for b in frame["buffer"]:
            total = pickle.loads(b) if total is None else f.merge(total, pickle.loads(b))
        return pd.DataFrame([[*key, f.finish(total)]], columns=[*by, out], dtype=object)

    buffers = df.select(*by, *(c for c in columns if c not in by)).mapInPandas(partial, f"{keys}, buffer binary")
    return buffers.groupBy(*by).applyInPandas(whole, f"{keys}, `{out}` {f.kind}")


#: Groups whose buffers a task holds at a time.
GROUPS = 50_000


class LeastSquares(Aggregate):
    """Coefficients (constant first) of the first column on the others, by the normal equations; rows with a null are left
    out, and a group whose equations have no single answer gives null."""

    kind = "array<double>"

    def update(self, buffer, rows):
        rows = rows.dropna().to_numpy(dtype=float)
        x = np.column_stack([np.ones(len(rows)), rows[:, 1:]])
        own = (x.T @ x, x.T @ rows[:, 0], len(rows))
        return own if buffer is None else self.merge(buffer, own)

    def merge(self, a, b):
        return tuple(p + q for p, q in zip(a, b, strict=True))

    def finish(self, buffer):
        xx, xy, n = buffer
        if n < len(xx) or np.linalg.matrix_rank(xx) < len(xx):
            return None
        return np.linalg.solve(xx, xy).tolist()
