"""A builder that threads a frame through steps; steps that add a column return its reference."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from tessera.functions.expr import Col, Expr
from tessera.operators.frame import Frame


class Pipeline:
    def __init__(self, frame: Frame):
        self.frame = frame

    def modify(self, f: Callable[[Frame], Frame]) -> None:
        self.frame = f(self.frame)

    def inspect(self, f: Callable[[Frame], Any]) -> Any:
        return f(self.frame)

    def derive(self, name: str, e: Expr) -> Expr:
        self.frame = self.frame.derive(name, e)
        return Col(name)

    def rename(self, e: Expr, name: str) -> Expr:
        self.frame = self.frame.rename(e.name, name)
        return Col(name)

    def filter_where(self, e: Expr) -> None:
        self.frame = self.frame.filter_where(e)

    def filter_just(self, e: Expr) -> Expr:
        self.frame = self.frame.filter_just(e.name)
        return e

    def impute(self, e: Expr, value: Any) -> Expr:
        self.frame = self.frame.impute(e.name, value)
        return e

    def sample(self, seed: int, p: float) -> None:
        self.frame = self.frame.sample(seed, p)

    def take(self, n: int) -> None:
        self.frame = self.frame.take(n)


def run(frame: Frame, steps: Callable[[Pipeline], Any]) -> tuple[Any, Frame]:
    """(what the steps return, the frame after them)."""
    p = Pipeline(frame)
    return steps(p), p.frame


def eval_(frame: Frame, steps: Callable[[Pipeline], Any]) -> Any:
    return run(frame, steps)[0]


def exec_(frame: Frame, steps: Callable[[Pipeline], Any]) -> Frame:
    return run(frame, steps)[1]
