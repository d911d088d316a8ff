"""Equi-joins on columns of the same names. Missing keys meet each other; columns of the side that is
not preserved get the prefix ``Right_`` where their names clash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.frame import Frame

HOW = ("inner", "left", "right", "full_outer")


def join(how: str, keys: Sequence[str], right: Frame, left: Frame) -> Frame:
    if how not in HOW:
        raise ValueError(f"a join is one of {', '.join(HOW)}")
    return {"inner": inner_join, "left": left_join, "right": right_join, "full_outer": full_outer_join}[how](keys, right, left)


def inner_join(keys: Sequence[str], right: Frame, left: Frame) -> Frame:
    out = _joined(keys, left, right, "inner")
    rest = {_clash(c, left) for c in right.required - set(keys)}
    return Frame(out, left.required | rest)


def left_join(keys: Sequence[str], right: Frame, left: Frame) -> Frame:
    """All rows of left."""
    return Frame(_joined(keys, left, right, "left"), left.required)


def right_join(keys: Sequence[str], right: Frame, left: Frame) -> Frame:
    """All rows of right, whose columns come first."""
    return left_join(keys, left, right)


def full_outer_join(keys: Sequence[str], right: Frame, left: Frame) -> Frame:
    return Frame(_joined(keys, left, right, "full"), left.required & right.required & set(keys))


def _clash(name: str, first: Frame) -> str:
    return f"Right_{name}" if name in first.columns else name


def _joined(keys: Sequence[str], first: Frame, second: Frame, how: str) -> DataFrame:
    keys = list(dict.fromkeys(keys))
    if not keys:
        raise ValueError("a join needs a key")
    first.check(*keys)
    second.check(*keys)
    taken = {*first.columns, *second.columns, *(_clash(c, first) for c in second.columns)}
    mine = {}
    for k in keys:  # names that no column has
        name = f"__k_{k}"
        while name in taken:
            name = "_" + name
        taken.add(name)
        mine[k] = name
    other = second.df.select(*(F.col(f"`{c}`").alias(mine[c] if c in keys else _clash(c, first)) for c in second.columns))
    # Plain equality where neither side can miss a key keeps the plan simple; both are hash joins.
    same = [first.df[f"`{k}`"] == other[f"`{mine[k]}`"] if k in first.required and k in second.required else first.df[f"`{k}`"].eqNullSafe(other[f"`{mine[k]}`"]) for k in keys]
    out = first.df.join(other, same, how)
    shown = [F.coalesce(first.df[f"`{k}`"], other[f"`{mine[k]}`"]).alias(k) if k in keys and how == "full" else first.df[f"`{k}`"] for k in first.columns]
    return out.select(*shown, *(other[f"`{c}`"] for c in other.columns if c not in mine.values()))
