"""What the parser makes of a script."""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import Span


@dataclass(frozen=True)
class Name:
    text: str
    span: Span


@dataclass(frozen=True)
class Path:
    """``name`` or ``database.name``."""

    database: Name | None
    name: Name

    def __str__(self) -> str:
        return f"{self.database.text}.{self.name.text}" if self.database else self.name.text


@dataclass(frozen=True)
class Literal:
    kind: str  # Int64, Bool or String
    value: int | bool | str
    span: Span


@dataclass(frozen=True)
class Comparison:
    column: Name
    operator: str  # =, <, >, <= or >=
    value: Literal


@dataclass(frozen=True)
class Combination:
    operator: str  # and, or
    left: Predicate
    right: Predicate


Predicate = Comparison | Combination


@dataclass(frozen=True)
class CreateDatabase:
    name: Name


@dataclass(frozen=True)
class CreateType:
    path: Path
    fields: tuple[tuple[Name, Path], ...]


@dataclass(frozen=True)
class CreateTable:
    path: Path
    type_path: Path
    primary_key: tuple[Name, ...]


@dataclass(frozen=True)
class Insert:
    path: Path
    values: tuple[tuple[Name, Literal], ...]


@dataclass(frozen=True)
class Select:
    columns: tuple[Name, ...] | None  # None: all of them
    path: Path
    where: Predicate | None = None


Statement = CreateDatabase | CreateType | CreateTable | Insert | Select
