"""Experiments: one derivation under many settings."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overridden(config, pairs: list[str]):
    """``config`` with ``name=value`` pairs put in, each read as the kind of the value it replaces."""
    known = {f.name for f in fields(config)}
    patch = {}
    for name, _, text in (p.partition("=") for p in pairs):
        if name not in known:
            raise ValueError(f"no setting {name!r}; there are {', '.join(sorted(known))}")
        old = getattr(config, name)
        patch[name] = text.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(text)
    return replace(config, **patch)


def grid(config, **values: list) -> list:
    """A config for every combination of the ``values``."""
    return [replace(config, **dict(zip(values, chosen, strict=True))) for chosen in itertools.product(*values.values())]


def sweep(configs: list, derive: Callable[[object], DataFrame]) -> DataFrame:
    """The rows that ``derive`` gives for each config, with its number (``setting``)."""
    out = None
    for i, c in enumerate(configs):
        rows = derive(c).select(F.lit(i).alias("setting"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def threshold_sweep(rows: DataFrame, score: str, thresholds: list[float], measures: dict) -> DataFrame:
    """``measures`` (name: column) over the rows whose ``score`` reaches each threshold, in one pass;
    a threshold that none reaches has a row of its own with ``n`` 0."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    every = rows.select("*", at.alias("threshold"))
    reached = F.col(score) >= F.col("threshold")
    return every.groupBy("threshold").agg(F.count_if(reached).alias("n"), *[m(reached).alias(name) for name, m in measures.items()])
