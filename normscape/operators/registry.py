"""Extension points: scoring methods, weightings, bring-your-own models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normscape.operators import weights

#: name -> (label prefix, function of (texts, items) to (traj_idx, item_idx, score))
SCORING: dict[str, tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]] = {}


def register_scoring_method(name: str, prefix: str, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    if name in SCORING:
        raise ValueError(f"scoring method {name!r} is registered")
    SCORING[name] = (prefix, fn)


#: name -> a core of its own for a weighting: systems to (arm, struct_idx, value)
CORES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_weighting_method(name: str, raw: Callable[[Column, Column, Column], Column], core: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """raw: the unnormalised weight of (logprob, n_tokens, the arm's largest logprob); core: in place of the weighted mean."""
    if name in weights.RAW:
        raise ValueError(f"weighting {name!r} is registered")
    weights.RAW[name] = raw
    if core is not None:
        CORES[name] = core


def core_of(systems: DataFrame, name: str) -> DataFrame:
    """(arm, struct_idx, value) by a registered weighting: its own core, else the weighted mean. Arms without one are left out."""
    from normscape.operators.cores import generalized_core

    return CORES[name](systems) if name in CORES else generalized_core(weights.with_weight(systems, name), 1, 1)


def score_texts(texts: DataFrame, items: dict[str, DataFrame]) -> DataFrame:
    """(traj_idx, method, struct_idx, item_idx, score) of all methods that have items, methods in name order.

    items: (struct_idx, item_idx, ..) per method; bundles come back as item rows.
    """
    out = None
    for name in sorted(items):
        scored = SCORING[name][1](texts, items[name]).select("traj_idx", F.lit(name).alias("method"), "struct_idx", "item_idx", "score")
        out = scored if out is None else out.unionByName(scored)
    return out


def score_with_model(texts: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]], text_col: str = "text") -> DataFrame:
    """Add score by a user's model, loaded once a task, on Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for b in batches:
            yield predict(b)

    return texts.withColumn("score", run(F.col(text_col)))


def resume(todo: DataFrame, done: DataFrame, keys: tuple = ("traj_idx", "item_idx")) -> DataFrame:
    return todo.join(done, list(keys), "left_anti")
