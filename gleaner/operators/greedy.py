"""Greedy choice of features from scores: one vector and two small matrices, all on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

CRITERIA = ("jmim", "cmim", "mrmr", "mim", "jmi")


class Informations(Protocol):
    """What the search asks. Candidates are numbered from 0."""

    def relevance(self) -> np.ndarray:
        """I(x; y) of every candidate."""

    def redundancy(self, s: int) -> np.ndarray:
        """I(x; s) of every candidate x."""

    def gain(self, s: int) -> np.ndarray:
        """I(x; y | s) of every candidate x."""

    def gain_given(self, fixed: list[int]) -> np.ndarray:
        """I(x; y | fixed without x) of every candidate x."""


@dataclass
class Matrices:
    """Informations that have been computed already."""

    mi: np.ndarray
    pair: np.ndarray
    cmi: np.ndarray
    fixed: Callable[[list[int]], np.ndarray] | None = None

    def relevance(self) -> np.ndarray:
        return self.mi

    def redundancy(self, s: int) -> np.ndarray:
        return self.pair[:, s]

    def gain(self, s: int) -> np.ndarray:
        return self.cmi[:, s]

    def gain_given(self, fixed: list[int]) -> np.ndarray:
        return self.fixed(fixed)


@dataclass
class Chosen:
    places: list[int] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)


def ranked(mi: np.ndarray) -> list[int]:
    """All places by falling information; equal ones in order."""
    return np.argsort(-np.asarray(mi, float), kind="stable").tolist()


def shortlist(mi: np.ndarray, significant: np.ndarray, k: int) -> list[int]:
    return [i for i in ranked(mi) if significant[i]][:k]


def choose(info: Informations, criterion: str, most: int, least: float = 0.0, cmim_m: int = 2, cmim_approx: str | None = None) -> Chosen:
    """Takes the best candidate again and again, the earliest of equals, until none reaches ``least``.

    mrmr: I(x;y) less the mean of I(x;s) over the chosen s; mim: less their sum; jmi: the sum of I(x;y|s); jmim: the
    least of them; cmim: I(x;y|S) with S the ``cmim_m`` candidates of most information, without x (or jmim if approximated).
    The first choice is by I(x;y). Each round updates a running sum or minimum: it costs one column of a matrix.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}, not {criterion!r}")
    if criterion == "cmim" and cmim_approx == "max_min":
        criterion = "jmim"
    mi = np.asarray(info.relevance(), float)
    out, free = Chosen(), np.ones(len(mi), bool)
    score, kept = mi.copy(), None
    while free.any() and len(out.places) < most:
        open_score = np.where(free, score, -np.inf)
        best = int(open_score.argmax())
        if not open_score[best] >= least:
            break
        out.places.append(best)
        out.scores.append(float(open_score[best]))
        free[best] = False
        if not free.any() or len(out.places) == most:
            break
        if criterion == "cmim":
            if kept is None:  # the fixed set doesn't change, so neither do the scores
                kept = np.asarray(info.gain_given(ranked(mi)[: min(cmim_m, len(mi))]), float)
            score = kept
        elif criterion in ("mrmr", "mim"):
            kept = info.redundancy(best) + (0 if kept is None else kept)
            score = mi - kept / (len(out.places) if criterion == "mrmr" else 1)
        else:
            gain = np.asarray(info.gain(best), float)
            kept = gain if kept is None else kept + gain if criterion == "jmi" else np.minimum(kept, gain)
            score = kept
    return out
