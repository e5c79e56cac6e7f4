"""Typed expression tree."""

from __future__ import annotations

from dataclasses import dataclass, field

SCALAR, STRING, VECTOR, MATRIX = "scalar", "string", "instant vector", "range vector"


@dataclass(frozen=True)
class Expr:
    @property
    def type(self) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Number(Expr):
    value: float
    type = SCALAR


@dataclass(frozen=True)
class Text(Expr):
    value: str
    type = STRING


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str
    value: str


@dataclass(frozen=True)
class Selector(Expr):
    """An instant selector, or a range selector if range_ms is set."""

    matchers: tuple[Matcher, ...]
    range_ms: int | None = None
    offset_ms: int = 0
    at: float | str | None = None

    @property
    def type(self) -> str:
        return VECTOR if self.range_ms is None else MATRIX


@dataclass(frozen=True)
class Subquery(Expr):
    inner: Expr
    range_ms: int
    step_ms: int | None
    offset_ms: int = 0
    at: float | str | None = None
    type = MATRIX


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    type: str = VECTOR


@dataclass(frozen=True)
class Aggregate(Expr):
    op: str
    inner: Expr
    param: Expr | None = None
    grouping: tuple[str, ...] = ()
    without: bool = False
    type = VECTOR


@dataclass(frozen=True)
class Matching:
    labels: tuple[str, ...] = ()
    on: bool = False
    card: str = "one-to-one"
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    bool_modifier: bool = False
    matching: Matching = field(default_factory=Matching)

    @property
    def type(self) -> str:
        return SCALAR if self.left.type == self.right.type == SCALAR else VECTOR


@dataclass(frozen=True)
class Negate(Expr):
    inner: Expr

    @property
    def type(self) -> str:
        return self.inner.type
