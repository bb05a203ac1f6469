"""What a statement can be refused for. Parse failures are in ``stratum.lang.parser``."""

from __future__ import annotations


class PlanError(Exception):
    """A statement that parsed but can't run; nothing of it was done."""

    def __init__(self, *args, problems: list[PlanError] | None = None):
        super().__init__(*args)
        #: All that is wrong with the statement, this error first.
        self.problems = problems or [self]

    def __str__(self) -> str:
        return f"{type(self).__name__}: {', '.join(map(str, self.args))}"


def refuse(problems: list[PlanError]) -> None:
    """Raise the first problem, if there is one, with all of them."""
    if problems:
        problems[0].problems = problems
        raise problems[0]


class DatabaseNotFound(PlanError):
    pass


class TableNotFound(PlanError):
    pass


class TypeNotFound(PlanError):
    """No such record type, or a field type that the language does not have."""


class UnqualifiedPath(PlanError):
    """A path without its database."""


class FieldNotFound(PlanError):
    pass


class MissingField(PlanError):
    pass


class TypeMismatch(PlanError):
    pass


class DuplicateField(PlanError):
    """A record type that names a field twice."""


class NullValue(PlanError):
    """A null key or field; the language has none."""


class IntegerOverflow(PlanError):
    """An integer literal beyond 64 bits."""


class InvalidName(PlanError):
    """A name that holds NUL."""


class DuplicateDatabase(PlanError):
    pass


class DuplicateType(PlanError):
    pass


class DuplicateTable(PlanError):
    pass
