"""What statements are once they are read."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Output:
    name: str
    alias: str | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Compare:
    column: str
    op: str  # = != < <= > >=
    value: Any


@dataclass(frozen=True)
class Between:
    column: str
    low: Any
    high: Any


@dataclass(frozen=True)
class In:
    column: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool


@dataclass(frozen=True)
class Finetuned:
    negated: bool


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Order:
    key: str
    descending: bool = False
    function: str | None = None


@dataclass(frozen=True)
class Change:
    base_indices: tuple[int, ...]
    reader: str
    change_indices: tuple[int, ...]


@dataclass(frozen=True)
class Reader:
    name: str
    changes: tuple[Change, ...] = ()


@dataclass(frozen=True)
class Readers:
    readers: tuple[Reader, ...]
    benchmark: bool = False


@dataclass(frozen=True)
class Classifier:
    name: str
    params: tuple[tuple[str, float], ...] = ()

    @property
    def value(self) -> str:
        return f"{self.name}({' '.join(f'{k}={v}' for k, v in self.params)})" if self.params else self.name


@dataclass(frozen=True)
class Select:
    outputs: tuple[Output, ...]
    source: str
    where: Any = None
    order: Order | None = None
    trained: Readers | None = None
    tested: Readers | None = None
    classifiers: tuple[Classifier, ...] = ()
    limit: int | None = None
    other_than: str | None = None
    chunk: int | str | None = None
    budget: int | str | None = None
    by: str | None = None  # a ranking extension: this is RANK
    params: dict[str, Any] = field(default_factory=dict)
    wait: bool = False


@dataclass(frozen=True)
class Explain:
    query: Select
    json: bool = False


@dataclass(frozen=True)
class Declare:
    name: str
    query: Select


@dataclass(frozen=True)
class Print:
    name: str  # or *


@dataclass(frozen=True)
class Register:
    name: str
    columns: tuple[str, ...]
    values: tuple


@dataclass(frozen=True)
class Finetune:
    models: tuple[str, ...]
    readers: tuple[str, ...]


@dataclass(frozen=True)
class Use:
    place: str


@dataclass(frozen=True)
class Purge:
    pass
