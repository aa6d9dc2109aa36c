"""Joins of tables that must hold the same keys (J7), with their rows counted on the way."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def zip_by_key(frames: Sequence[DataFrame], key: str = "session_id") -> tuple[DataFrame, Callable[[], int]]:
    """The inner join of ``frames`` on ``key``, and a check for after it has been written.

    The rows of each input and of the result are counted while the join runs, without a pass of
    their own. The check returns their number, or raises an error if they differ: a table lacks a
    key, or has one twice.
    """
    counters = [Observation(f"zip-{uuid.uuid4().hex}") for _ in range(len(frames) + 1)]
    count = F.count(F.lit(1)).alias("n")
    inputs = [f.observe(o, count) for f, o in zip(frames, counters, strict=False)]
    out = reduce(lambda a, b: a.join(b, key), inputs).observe(counters[-1], count)

    def check() -> int:
        n = [o.get["n"] for o in counters]
        if len(set(n)) > 1:
            raise ValueError(f"inputs of {n[:-1]} rows gave {n[-1]} by {key}")
        return n[-1]

    return out, check
