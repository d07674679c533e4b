"""Detectors by name: the extension point.  A detector learns tables from the training
windows (series_id, q, v) of all series at once and scores windows of the same shape, then or
later, from these tables alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, neighbors

#: Tables by name: all that a detector has learnt.
State = dict[str, DataFrame]


@dataclass(frozen=True)
class Detector:
    fit: Callable[[DataFrame], State]
    score: Callable[[State, DataFrame], DataFrame]

    def __call__(self, train: DataFrame, query: DataFrame) -> DataFrame:
        return self.score(self.fit(train), query)


_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, fit: Callable, score: Callable[[State, DataFrame], DataFrame] | None = None) -> None:
    """With ``score``, ``fit(train)`` gives the tables.  Without it, ``fit(train, query)`` does
    both, and what it learns is the training windows themselves."""
    if score is None:
        both = fit
        fit, score = (lambda train: {"train": train}), (lambda state, query: both(state["train"], query))
    _DETECTORS[name] = Detector(fit, score)


def detector(name: str) -> Detector:
    return _DETECTORS[name]


def detectors() -> list[str]:
    return sorted(_DETECTORS)


def _memory(train: DataFrame) -> DataFrame:
    return train.select("series_id", F.col("q").alias("m"), F.col("v").alias("u"))


#: Neighbours by track: one channel (U) or many (M).
NEIGHBORS = {"U": 50, "M": 50}
LOF_NEIGHBORS = {"U": 30, "M": 50}
FOREST = {"U": (150, 1.0), "M": (25, 0.8)}
VARIANCE = {"U": None, "M": 0.25}


def _add(track: str, suffix: str) -> None:
    trees, share = FOREST[track]
    register_detector("knn" + suffix, lambda train: {"memory": _memory(train)}, lambda state, query: neighbors.knn_score(state["memory"], query, NEIGHBORS[track]))
    register_detector("lof" + suffix, lambda train: {"memory": neighbors.lof_fit(_memory(train), LOF_NEIGHBORS[track])}, lambda state, query: neighbors.lof_score(state["memory"], query, LOF_NEIGHBORS[track]))
    register_detector("kmeans" + suffix, lambda train: {"centers": cluster.kmeans_centers(train)}, lambda state, query: cluster.kmeans_distance(state["centers"], query))
    register_detector("pca" + suffix, lambda train: {"components": cluster.principal_components(train, VARIANCE[track])}, lambda state, query: cluster.pca_distance(state["components"], query))
    register_detector("iforest" + suffix, lambda train: {"forest": cluster.grow_forest(train, trees, share)}, lambda state, query: cluster.forest_score(state["forest"], query))
    register_detector("exemplar" + suffix, cluster.exemplar_fit, cluster.exemplar_score)


_add("U", "")
_add("M", "_many")
