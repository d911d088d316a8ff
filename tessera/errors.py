"""Exceptions of the engine; unknown names come with the nearest known one."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class EngineError(Exception):
    """Base of all errors raised by the engine itself."""


class ColumnNotFound(EngineError):
    def __init__(self, name: str, known: Iterable[str], where: str = ""):
        near = difflib.get_close_matches(name, list(known), n=1, cutoff=0.4)
        hint = f" Did you mean '{near[0]}'?" if near else ""
        super().__init__(f"Column not found: '{name}'{f' in {where}' if where else ''}.{hint}")
        self.name = name


class TypeMismatch(EngineError):
    pass


class Unaggregated(EngineError):
    """An expression of an aggregation lies outside every aggregate."""


class MixedAggregation(EngineError):
    """An expression joins aggregated and unaggregated operands."""


class EmptyData(EngineError):
    pass


class WrongQuantile(EngineError):
    pass


class NotOptional(EngineError):
    """A column without missing values was asked to lose them."""


class DuplicateColumn(EngineError):
    pass


class ParseFailure(EngineError):
    pass
