"""Operators: named, with strict parameters, building a lazy DataFrame out of another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pydantic import BaseModel, ConfigDict
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import EngineError


class Params(BaseModel):
    model_config = ConfigDict(extra="forbid")


@dataclass
class Counts:
    """Figures of a table that are worked out in one aggregate, and only if asked for."""

    df: DataFrame | None = None
    of: dict[str, Column] = field(default_factory=dict)
    known: dict[str, Any] = field(default_factory=dict)

    @cached_property
    def values(self) -> dict[str, Any]:
        if not self.of or self.df is None:
            return dict(self.known)
        row = self.df.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in self.of.items()]).first()
        return dict(self.known) | row.asDict()

    def __getitem__(self, name: str) -> Any:
        return self.values[name]


@dataclass
class OpResult:
    """df: the table that goes on; aux: further tables by name; warnings: texts, or functions of the counts that give
    texts; report: of validation."""

    df: DataFrame
    aux: dict[str, DataFrame] = field(default_factory=dict)
    counts: Counts = field(default_factory=Counts)
    warnings: list[str | Callable[[dict], str | None]] = field(default_factory=list)
    report: Any = None

    def told(self) -> list[str]:
        texts = [w if isinstance(w, str) else w(self.counts.values) for w in self.warnings]
        return [t for t in texts if t]


@dataclass(frozen=True)
class Operator:
    name: str
    params: type[Params]
    build: Callable[..., OpResult]
    destructive: Callable[[Any], bool]
    #: Whether build() takes a dict of tables instead of one.
    many: bool = False
    audit: str = ""


REGISTRY: dict[str, Operator] = {}


def operator(name: str, params: type[Params], destructive: Callable[[Any], bool] = lambda p: False, many: bool = False):
    """Registers a function (df, params) -> OpResult; many: ({name: df}, params)."""

    def add(build: Callable[..., OpResult]) -> Callable[..., OpResult]:
        REGISTRY[name] = Operator(name, params, build, destructive, many, (build.__doc__ or name).strip().split("\n")[0])
        return build

    return add


def apply(name: str, table: DataFrame | dict[str, DataFrame], **parameters: Any) -> OpResult:
    """Applies an operator by name, for use without a plan."""
    if name not in REGISTRY:
        raise EngineError(f"unknown operation {name!r}")
    op = REGISTRY[name]
    return op.build(table, op.params.model_validate(parameters))
