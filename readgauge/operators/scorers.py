"""User-supplied text measures, run as Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCORERS: dict[str, Callable] = {}


def register_scorer(name: str, fn: Callable[[pd.Series], pd.Series], return_type: str = "double") -> Callable:
    """Make ``fn``, from a batch of texts to a batch of values, usable as a column function."""

    def scorer(texts: pd.Series) -> pd.Series:
        return fn(texts)

    _SCORERS[name] = F.pandas_udf(scorer, return_type)
    return _SCORERS[name]


def register_model_scorer(name: str, load: Callable[[], Callable[[pd.Series], pd.Series]],
                          return_type: str = "double") -> Callable:
    """Like ``register_scorer`` for a model: ``load`` runs once per task, not once per batch."""

    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield model(texts)

    scorer.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    _SCORERS[name] = F.pandas_udf(scorer, return_type)
    return _SCORERS[name]


def score(name: str, text: Column | str) -> Column:
    if name not in _SCORERS:
        raise KeyError(f"no scorer {name!r}; registered: {sorted(_SCORERS)}")
    return _SCORERS[name](text)
