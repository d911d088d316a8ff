"""Feature synthesis: a beam search over expressions, scored by Spark a whole beam at a time.

A beam becomes a program of numpy operations in which what expressions share is computed once for each
block of rows; tasks return a few sums of each expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from math import floor, isfinite, log10, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import functions as fn
from tessera.errors import EmptyData
from tessera.functions.expr import Binary, Col, Expr, If, Lit, Unary, normalize, size
from tessera.operators.frame import Frame

#: Expressions of one program, and rows that it works on at a time.
CHUNK, BLOCK = 500, 4096


class Loss(Enum):
    PEARSON = "squared correlation"
    MSE = "mean squared error"
    F1 = "F1 of expression > 0"


@dataclass(frozen=True)
class BeamConfig:
    depth: int = 2
    beam: int = 100
    loss: Loss = Loss.PEARSON
    conditionals: bool = False


def is_literal(e: Expr) -> bool:
    return isinstance(e, Lit)


def is_conditional(e: Expr) -> bool:
    return isinstance(e, If)


def round_significant(x: float, digits: int = 2) -> float:
    return x if x == 0 or not isfinite(x) else round(x, digits - 1 - floor(log10(abs(x))))


def constants(frame: Frame, target: str) -> list[Lit]:
    """Percentiles 1, 25, 75 and 99, variance and deviation of all numeric columns but the target, at
    two significant digits, from one aggregation."""
    names = [n for n in _numeric(frame) if n != target]
    aggs = []
    for i, n in enumerate(names):
        c = frame._c(n).cast("double")
        aggs += [F.percentile(c, F.array(*(F.lit(p) for p in (0.01, 0.25, 0.75, 0.99)))).alias(f"p{i}"), F.var_samp(c).alias(f"v{i}"), F.stddev_samp(c).alias(f"s{i}")]
    if not aggs:
        return []
    r = frame.df.agg(*aggs).first()
    found = {round_significant(v) for i in range(len(names)) for v in [*(r[f"p{i}"] or []), r[f"v{i}"], r[f"s{i}"]] if v is not None and isfinite(v)}
    return [Lit(v) for v in sorted(found)]


def _numeric(frame: Frame) -> list[str]:
    return [f.name for f in frame.df.schema.fields if isinstance(f.dataType, T.NumericType)]


def conditions(exprs: list[Expr]) -> list[Expr]:
    """Each expression that is no literal, compared with every other one, and the negations."""
    plain = [a <= b for a in exprs if not is_literal(a) for b in exprs if not a.same(b)]
    return plain + [~c for c in plain]


def grow(base: list[Expr], now: list[Expr], conditionals: bool) -> list[Expr]:
    """One step's new expressions: unary functions of each, and binary ones with the base."""
    out: list[Expr] = []
    for e in now:
        if is_literal(e):
            continue
        out += [abs(e), fn.sqrt(abs(e)), fn.log(abs(e) + 1.0), e**2, e**3, fn.relu(e), fn.signum(e), fn.sin(e), fn.cos(e)]
    for a in now:
        for b in base:
            if is_literal(a) and is_literal(b):
                continue
            out += [a + b, a - b, a * b, a / b]
            if not is_literal(b):
                out += [fn.min_(a, b), fn.max_(a, b)]
    if conditionals:
        out += [If(c, a, b) for c in conditions(base) for a in base for b in base if not a.same(b) and not (is_literal(a) and is_literal(b))]
    return unique(out)


def unique(exprs: list[Expr]) -> list[Expr]:
    """Structurally different expressions, operands of commutative operators in order."""
    return list({repr(normalize(e).key()): normalize(e) for e in exprs}.values())


# --- programs: values are (numbers, where they are missing or None) ---------------------------------


def _either(*nulls):
    found = [n for n in nulls if n is not None]
    return None if not found else found[0] if len(found) == 1 else np.logical_or.reduce(found)


def _divide(a, b):
    by_zero = np.where((a > 0) | np.isnan(a), np.inf, np.where(a < 0, -np.inf, np.nan))
    return np.where(b == 0, by_zero, a / b)


def _power(a, k: int):
    if k > 16:
        return np.power(a, float(k))
    out = np.ones_like(a)
    for i in range(k):
        out = out * a if i else a
    return out


def _less(x, y, strict: bool):
    """x < y or x <= y: what is missing is below all else, NaN above."""
    (a, an), (b, bn) = x, y
    less = (a < b) | (np.isnan(b) & ~np.isnan(a)) if strict else (a <= b) | np.isnan(b)
    if an is not None or bn is not None:
        an, bn = (np.zeros(np.shape(v), bool) if n is None else n for v, n in ((a, an), (b, bn)))
        less = np.where(an, ~bn if strict else True, less & ~bn)
    return less


_UNARY = {"abs": np.abs, "sqrt": np.sqrt, "log": np.log, "signum": np.sign, "sin": np.sin, "cos": np.cos, "relu": lambda x: np.maximum(0.0, x)}
_BINARY = {"add": np.add, "sub": np.subtract, "mul": np.multiply, "divide": _divide}
_TESTS = {"lt": lambda x, y: _less(x, y, True), "le": lambda x, y: _less(x, y, False), "gt": lambda x, y: _less(y, x, True), "ge": lambda x, y: _less(y, x, False)}


def _apply(name: str, k, parts: list):
    if name in _TESTS:
        return _TESTS[name](*parts), None
    if name == "not":
        return ~parts[0][0], None
    if name == "if":
        (test, _), (a, an), (b, bn) = parts
        lost = None if an is None and bn is None else np.where(test, False if an is None else an, False if bn is None else bn)
        return np.where(test, a, b), lost
    values, nulls = [v for v, _ in parts], [n for _, n in parts]
    if name == "max":  # missing only where both are
        if nulls[0] is None and nulls[1] is None:
            return np.maximum(*values), None
        an, bn = (np.zeros(np.shape(v), bool) if n is None else n for v, n in parts)
        return np.where(an, values[1], np.where(bn, values[0], np.maximum(*values))), an & bn
    if name == "min":
        return np.fmin(*values), _either(*nulls)
    if name == "pow":
        return _power(values[0], k), nulls[0]
    return (_UNARY[name](*values) if name in _UNARY else _BINARY[name](*values)), _either(*nulls)


class _Program:
    """steps: (operation, parameter, places of operands); an operation "leaf" is a column of the table, which
    Spark computes, "lit" a number; outs: the places of the expressions."""

    def __init__(self, exprs: list[Expr]):
        self.steps: list[tuple] = []
        self.leaves: list[Expr] = []
        self._known: dict[tuple, int] = {}
        self.outs = [self._place(e) for e in exprs]

    def _place(self, e: Expr) -> int:
        key = e.key()
        if key not in self._known:
            step = self._step(e)
            self._known[key] = len(self.steps)
            self.steps.append(step)
        return self._known[key]

    def _step(self, e: Expr) -> tuple:
        if isinstance(e, Lit) and isinstance(e.value, (int, float)):
            return "lit", float(e.value), ()
        if isinstance(e, If):
            if isinstance(e.test, (Binary, Unary)) and self._tests(e.test):
                return "if", None, tuple(map(self._place, e.children()))
        elif isinstance(e, Unary) and (e.symbol in _UNARY or e.symbol == "not" and self._tests(e)):
            return e.symbol, None, (self._place(e.arg),)
        elif isinstance(e, Binary) and e.name == "pow" and isinstance(e.right, Lit) and e.right.value >= 0:
            return "pow", e.right.value, (self._place(e.left),)
        elif isinstance(e, Binary) and (e.name in _BINARY or e.name in _TESTS or e.name in ("min", "max")) and e.make is None:
            return e.name, None, (self._place(e.left), self._place(e.right))
        self.leaves.append(e)
        return "leaf", len(self.leaves) - 1, ()

    def _tests(self, e: Expr) -> bool:
        return isinstance(e, Binary) and e.name in _TESTS or isinstance(e, Unary) and e.symbol == "not" and self._tests(e.arg)

    def run(self, columns: list):
        """(numbers, missing) of each expression, in order."""
        done: list = []
        rows = len(columns[0][0])
        for name, k, places in self.steps:
            done.append(columns[k] if name == "leaf" else (np.full(rows, k), None) if name == "lit" else _apply(name, k, [done[p] for p in places]))
        return [done[p] for p in self.outs]


def _fingerprint(x: np.ndarray) -> int:
    """A sum of hashes of the numbers at nine places, whatever their order."""
    h = (np.where(np.abs(x) < 9e6, np.round(x, 9), x) + 0.0).view(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return int((h ^ (h >> np.uint64(31))).sum(dtype=np.uint64))


def _moments(x: np.ndarray, y: np.ndarray) -> tuple:
    """n, means and central sums: of x twice, of y twice, of both."""
    if not len(x):
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0
    mx, my = x[0] + np.mean(x - x[0]), y[0] + np.mean(y - y[0])  # exact where all are equal
    a, b = x - mx, y - my
    return len(x), float(mx), float(my), float(a @ a), float(b @ b), float(a @ b)


def _joined(p: tuple, q: tuple) -> tuple:
    """Moments of two parts together."""
    n = p[0] + q[0]
    if not p[0] or not q[0]:
        return q if not p[0] else p
    dx, dy, w = q[1] - p[1], q[2] - p[2], p[0] * q[0] / n
    return n, p[1] + dx * q[0] / n, p[2] + dy * q[0] / n, p[3] + q[3] + dx * dx * w, p[4] + q[4] + dy * dy * w, p[5] + q[5] + dx * dy * w


def _sums(x: np.ndarray, y: np.ndarray, loss: Loss) -> tuple:
    """What the score is made of; rows without a target are left out."""
    if loss is Loss.PEARSON:
        return _moments(x, y)
    if loss is Loss.MSE:
        return len(x), float(((x - y) ** 2).sum())
    hit, own = x > 0, (y > 0) | np.isnan(y)
    return int((hit & own).sum()), int((hit & ~own).sum()), int((~hit & own).sum())


def _score(sums: tuple, loss: Loss) -> float | None:
    if loss is Loss.F1:
        return f1_from_counts(*(int(v) for v in sums))
    if not sums[0]:
        return None
    if loss is Loss.MSE:
        return -sums[1] / sums[0]
    spread = sqrt(sums[3] / sums[0]) * sqrt(sums[4] / sums[0]) if sums[3] >= 0 and sums[4] >= 0 else 0.0
    return (sums[5] / sums[0] / spread) ** 2 if spread else None


def _measure(frame: Frame, exprs: list[Expr], target: Column, loss: Loss) -> list[tuple[Expr, float, int]]:
    """(expression, score, fingerprint) of those with finite values on every row; greater is better."""
    if not exprs:
        return []
    programs = [_Program(exprs[s : s + CHUNK]) for s in range(0, len(exprs), CHUNK)]
    leaves = {e.key(): e for p in programs for e in p.leaves}
    at = {k: i for i, k in enumerate(leaves)}
    work = [(p, [at[e.key()] for e in p.leaves]) for p in programs]
    for p in programs:  # expressions stay on the driver
        p.leaves, p._known = [], {}
    cells = [frame.compile(e).cast("double").alias(f"x{i}") for i, e in enumerate(leaves.values())]
    # A small file is one task to read; its rows are dealt out to all cores.
    rows = frame.df.select(*cells, target.cast("double").alias("y")).repartition(frame.df.sparkSession.sparkContext.defaultParallelism)

    def sums(batches):
        import pyarrow as pa

        found: dict[int, list] = {}  # sums and fingerprint, None where a value is not finite
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                columns = [(c.fill_null(0.0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False) if c.null_count else None) for c in part.columns]
                y, lost = columns.pop()
                first = 0
                with np.errstate(all="ignore"):
                    for program, places in work:
                        for i, (x, null) in enumerate(program.run([columns[p] for p in places] or [(y, None)]), first):
                            if i in found and found[i] is None:
                                continue
                            if null is not None and null.any() or not np.isfinite(x).all():
                                found[i] = None
                                continue
                            own = _sums(x, y, loss) if lost is None else _sums(x[~lost], y[~lost], loss)
                            before = found.get(i)
                            found[i] = [own if before is None else _added(before[0], own, loss), (_fingerprint(x) + (before[1] if before else 0)) % (1 << 64)]
                        first += len(program.outs)
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(found), pa.int32()), "sums": pa.array([None if v is None else list(map(float, v[0])) for v in found.values()], pa.list_(pa.float64())), "h": pa.array([None if v is None else str(v[1]) for v in found.values()], pa.string())})

    parts: list = [[] for _ in exprs]
    for r in rows.mapInArrow(sums, "i int, sums array<double>, h string").collect():  # tasks * expressions rows
        parts[r["i"]].append(r)
    out = []
    for e, own in zip(exprs, parts):
        if any(r["sums"] is None for r in own):
            continue
        total, h = (0,) * {Loss.PEARSON: 6, Loss.MSE: 2, Loss.F1: 3}[loss], 0
        for r in own:
            total, h = _added(total, tuple(r["sums"]), loss), (h + int(r["h"])) % (1 << 64)
        score = _score(total, loss)
        if score is not None and isfinite(score):
            out.append((e, score, h))
    return out


def _added(p: tuple, q: tuple, loss: Loss) -> tuple:
    return _joined(p, q) if loss is Loss.PEARSON else tuple(a + b for a, b in zip(p, q))


def search(frame: Frame, target: str, config: BeamConfig, use_constants: bool = False) -> list[tuple[Expr, float]]:
    """The final beam, best first; expressions of equal values on all rows count once, the smallest."""
    y = frame._c(target).cast("double")
    base: list[Expr] = [fn.to_double(Col(n)) for n in _numeric(frame) if n != target]
    if not base:
        raise EmptyData("there are no numeric columns to make features of")
    if use_constants:
        base += constants(frame, target)
    beam = [(e, s, h) for e, s, h in _measure(frame, [e for e in base if not is_literal(e)], y, config.loss)]
    for _ in range(config.depth):
        new = grow(base, [e for e, _, _ in beam] or base, config.conditionals)
        kinds: dict[int, tuple[Expr, float, int]] = {}
        for e, s, h in sorted(beam + _measure(frame, new, y, config.loss), key=lambda r: (size(r[0]), repr(r[0]))):
            kinds.setdefault(h, (e, s, h))
        beam = sorted(kinds.values(), key=lambda r: (-r[1], size(r[0]), repr(r[0])))[: config.beam]
    if not beam:
        raise EmptyData("no expression has finite values on every row")
    return [(e, s) for e, s, _ in beam]


def synthesize_feature(frame: Frame, target: str, config: BeamConfig | None = None) -> Expr:
    """The expression best correlated with the target."""
    return search(frame, target, config or BeamConfig())[0][0]


def fit_regression(frame: Frame, target: str, depth: int = 2, beam: int = 50) -> Expr:
    """The expression of least mean squared error."""
    return search(frame, target, BeamConfig(depth, beam, Loss.MSE), use_constants=True)[0][0]


def fit_classifier(frame: Frame, target: str, depth: int = 2, beam: int = 50) -> Expr:
    """1 where the expression of best F1 is above 0, else 0; the target is above 0 for the class."""
    best = search(frame, target, BeamConfig(depth, beam, Loss.F1), use_constants=True)[0][0]
    return fn.if_then_else(best > 0.0, 1, 0)


def f1_from_counts(tp: int, fp: int, fn_: int) -> float:
    return 2 * tp / (2 * tp + fp + fn_) if tp + fp + fn_ else 0.0


def f1_from_binary(frame: Frame, truth: str, predicted: str) -> float:
    a, b = frame._c(truth) > 0, frame._c(predicted) > 0
    r = frame.df.agg(F.count_if(a & b), F.count_if(~a & b), F.count_if(a & ~b)).first()
    return f1_from_counts(*r)


def satisfies(frame: Frame, e: Expr, target: str, tolerance: float = 1e-9) -> bool:
    """Whether the expression gives the target on every row."""
    gap = F.abs(frame.compile(e).cast("double") - frame._c(target).cast("double"))
    return frame.df.where(gap.isNull() | (gap > tolerance)).limit(1).count() == 0


