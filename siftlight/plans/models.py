"""Retrieval models and their parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from siftlight.plans import tree as T


class UnsupportedOperator(ValueError):
    """An operator that the retrieval model gives no meaning to."""

    def __init__(self, op: str, model: Model):
        super().__init__(f"#{op} is not defined for {type(model).__name__}")


@dataclass(frozen=True)
class Model:
    """``operators`` are the scored operators with a meaning; ``default`` joins bare words."""

    @property
    def operators(self) -> tuple[type[T.Scored], ...]:
        return ()

    @property
    def default(self) -> type[T.Scored]:
        return T.Or

    #: Digits to which scores are rounded before ranking, so that the order of additions can't part ties.
    digits = 6


@dataclass(frozen=True)
class UnrankedBoolean(Model):
    @property
    def operators(self):
        return (T.And, T.Or)


@dataclass(frozen=True)
class RankedBoolean(Model):
    @property
    def operators(self):
        return (T.And, T.Or)


def _within(value: float, name: str, low: float, high: float = float("inf")) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}], not {value}")


@dataclass(frozen=True)
class BM25(Model):
    k1: float = 1.2
    b: float = 0.75
    k3: float = 0.0

    def __post_init__(self) -> None:
        _within(self.k1, "k_1", 0)
        _within(self.b, "b", 0, 1)
        _within(self.k3, "k_3", 0)

    @property
    def operators(self):
        return (T.Sum,)

    @property
    def default(self):
        return T.Sum


@dataclass(frozen=True)
class Indri(Model):
    mu: float = 2500.0
    lam: float = 0.4
    digits = 12

    def __post_init__(self) -> None:
        _within(self.mu, "mu", 0)
        _within(self.lam, "lambda", 0, 1)

    @property
    def operators(self):
        return (T.And, T.WAnd, T.WSum)

    @property
    def default(self):
        return T.And


@dataclass(frozen=True)
class LearnToRank(BM25):
    """BM25 for the initial ranking, and the Indri parameters of the text features."""

    mu: float = 2500.0
    lam: float = 0.4

    def __post_init__(self) -> None:
        super().__post_init__()
        Indri(self.mu, self.lam)

    @property
    def indri(self) -> Indri:
        return Indri(self.mu, self.lam)


def model_of(params: Mapping[str, str]) -> Model:
    """The model that a parameter file names, case-insensitively; unknown names raise ValueError."""
    name = params.get("retrievalAlgorithm", "").strip().lower()

    def number(key: str, default: float) -> float:
        return float(params.get(key, default))

    bm25 = {"k1": ("BM25:k_1", 1.2), "b": ("BM25:b", 0.75), "k3": ("BM25:k_3", 0.0)}
    indri = {"mu": ("Indri:mu", 2500.0), "lam": ("Indri:lambda", 0.4)}
    makers = {
        "unrankedboolean": (UnrankedBoolean, {}),
        "rankedboolean": (RankedBoolean, {}),
        "bm25": (BM25, bm25),
        "indri": (Indri, indri),
        "letor": (LearnToRank, {**bm25, **indri}),
    }
    if name not in makers:
        raise ValueError(f"unknown retrieval algorithm {name!r}")
    make, keys = makers[name]
    return make(**{k: number(*v) for k, v in keys.items()})
