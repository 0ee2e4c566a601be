"""Progress as data: counts that Spark observes while the passes run, not in passes of their own."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _got(seen: Observation) -> dict:
    """What was observed; nothing where Spark saw that the relation is empty and never computed it."""
    try:
        return seen.get
    except Py4JJavaError as error:
        if "assertion failed" in str(error):  # how it says that there is no row of counts
            return {}
        raise


class Progress:
    """Named counts of relations as they are computed, handed to a listener as they come."""

    def __init__(self, listener: Callable[[dict[str, int]], None] | None = None):
        self._listener = listener
        self._observed: list[tuple[Observation, dict[str, str]]] = []
        self._told: dict[str, int] = {}

    def watch(self, rows: DataFrame, **counts: Column) -> DataFrame:
        """``rows``, of which the action that computes them also counts those where each condition holds.

        A count that several relations share is their sum. The rows must enter
        one action only, once.
        """
        seen = Observation()
        names = {f"c{i}": name for i, name in enumerate(counts)}
        self._observed.append((seen, names))
        return rows.observe(seen, *(F.count_if(F.coalesce(condition, F.lit(False))).alias(c) for c, condition in zip(names, counts.values(), strict=True)))

    def settled(self) -> dict[str, int]:
        """The counts of all relations watched so far: for after the actions that compute them."""
        for seen, names in self._observed:
            got = _got(seen)
            for c, name in names.items():
                self._told[name] = self._told.get(name, 0) + int(got.get(c) or 0)
        self._observed.clear()
        if self._listener is not None:
            self._listener(dict(self._told))
        return dict(self._told)
