"""Text and markdown tables of a frame's first rows."""

from __future__ import annotations

from tessera.operators.frame import Frame


def _cells(frame: Frame, n: int) -> tuple[list[str], list[str], list[list[str]], int]:
    rows = frame.df.limit(n).collect()
    kinds = [f.dataType.simpleString() + ("" if f.name in frame.required else "?") for f in frame.df.schema.fields]
    return frame.columns, kinds, [["" if v is None else str(v) for v in r] for r in rows], len(rows)


def show(frame: Frame, n: int = 20) -> str:
    """A bordered table; the types stand under the names."""
    names, kinds, rows, _ = _cells(frame, n)
    table = [names, kinds, *rows]
    wide = [max(len(r[i]) for r in table) for i in range(len(names))]
    line = lambda r: " | ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip()
    rule = "-+-".join("-" * w for w in wide)
    return "\n".join([line(names), rule, line(kinds), rule, *map(line, rows)])


def display(frame: Frame, n: int = 10) -> None:
    print(show(frame, n))


def to_markdown(frame: Frame, n: int = 20) -> str:
    names, kinds, rows, _ = _cells(frame, n)
    safe = lambda s: s.replace("|", "\\|").replace("\n", " ")
    head = [f"{safe(a)}<br>{b}" for a, b in zip(names, kinds)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(names), *([safe(c) for c in r] for r in rows)])
