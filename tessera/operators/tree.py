"""Decision trees as nested conditional expressions.

Candidate tests are thresholds of numeric terms (columns and what arithmetic makes of them), values of
text columns, missing values, and comparisons of text columns and of columns with missing values. Each level of a tree takes two jobs, whatever
the number of nodes and tests: one counts labels by node, test and side, and one counts them by node and
the outcomes of its best tests, which tells all their combinations. After the greedy growth, passes from
the bottom up give each node the test with fewest errors on the rows where exactly one branch is right.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import functions as fn
from tessera.errors import EmptyData, TypeMismatch
from tessera.functions.expr import Col, Expr, If, Lit, columns_of, size
from tessera.operators.frame import Frame

#: Different labels that a tree can tell apart.
MAX_LABELS = 1000
#: Accuracy of thresholds: exact places up to so many rows, within rows / ACCURACY places beyond.
ACCURACY = 100_000
#: Terms whose thresholds are looked up in one job.
CHUNK = 50


@dataclass(frozen=True)
class TestConfig:
    """depth: numeric terms join up to so many columns; expansion: tests that `and` and `or` join;
    disallowed: pairs of columns that no term or comparison joins; penalty: for each node of a test."""

    depth: int = 2
    expansion: int = 2
    disallowed: tuple[tuple[str, str], ...] = ()
    penalty: float = 0.05
    text: bool = True
    cross: bool = True
    arithmetic: bool = True

    __test__ = False  # not a test case

    def allows(self, *names: str) -> bool:
        return not any(a in names and b in names for a, b in self.disallowed)


@dataclass(frozen=True)
class TreeConfig:
    """pairs: the best tests of a node, whose combinations are tried."""

    max_depth: int = 4
    min_split: int = 5
    min_leaf: int = 1
    percentiles: tuple[int, ...] = tuple(range(0, 101, 10))
    pairs: int = 10
    iterations: int = 10
    tolerance: float = 1e-6
    tests: TestConfig = field(default_factory=TestConfig)


@dataclass
class Leaf:
    value: object


@dataclass
class Node:
    test: Expr
    yes: Node | Leaf
    no: Node | Leaf


# --- candidates ---------------------------------------------------------------------------------


@dataclass
class Candidates:
    """terms with their ascending thresholds, and plain tests."""

    terms: list[tuple[Expr, list[float]]]
    plain: list[Expr]

    def tests(self) -> list[Expr]:
        """Four comparisons for each threshold of each term, then the plain ones."""
        out = [c for e, limits in self.terms for v in limits for c in (e <= v, e >= v, e < v, e > v)]
        return out + self.plain

    def codes(self, frame: Frame) -> Column:
        """An array of whole numbers that tell the outcomes of all tests: for each term how its value
        lies to the thresholds (twice those below it, and 1 more at one), for each plain test 0 or 1."""
        cells, base = [], 0
        for e, limits in self.terms:
            x, all_ = frame.compile(e), F.array(*(F.lit(float(v)) for v in limits))
            place = 2 * F.size(F.filter(all_, x.__gt__)) + F.when(F.array_contains(all_, x), 1).otherwise(0)
            cells.append(F.when(x.isNull(), F.lit(base)).otherwise(place + base))
            base += 2 * len(limits) + 1
        for t in self.plain:
            cells.append(F.coalesce(frame.compile(t), F.lit(False)).cast("int") + base)
            base += 2
        return F.array(*(c.cast("int") for c in cells)) if cells else F.array().cast("array<int>")

    def width(self) -> int:
        return sum(2 * len(v) + 1 for _, v in self.terms) + 2 * len(self.plain)

    def held(self, counts: np.ndarray) -> np.ndarray:
        """(tests, labels): rows where each test holds, of counts (codes, labels)."""
        out, base = [], 0
        for _, limits in self.terms:
            k = 2 * len(limits) + 1
            upto = np.cumsum(counts[base : base + k], axis=0)
            for i in range(len(limits)):
                below, at = upto[2 * i], upto[2 * i + 1]
                out += [at, upto[-1] - below, below, upto[-1] - at]
            base += k
        for _ in self.plain:
            out.append(counts[base + 1])
            base += 2
        return np.array(out).reshape(len(out), counts.shape[1])


def numeric_terms(frame: Frame, config: TestConfig, exclude: str | None = None) -> list[Expr]:
    """Numeric columns as doubles, and sums, differences, products and ratios (0 where the divisor is)
    of different ones, `depth` columns long."""
    base = [fn.to_double(Col(f.name)) if not isinstance(f.dataType, T.DoubleType) else Col(f.name) for f in frame.df.schema.fields if f.name != exclude and isinstance(f.dataType, T.NumericType)]
    out, now = list(base), base
    for _ in range(1, config.depth if config.arithmetic else 1):
        now = [e for a in now for b in base if not a.same(b) and config.allows(*columns_of(a), *columns_of(b)) for e in (a + b, a - b, a * b, fn.if_then_else(b != 0.0, a / b, 0.0))]
        out += now
    return list({e.key(): e for e in out}.values())


def _thresholds(frame: Frame, terms: list[Expr], percentiles: tuple[int, ...]) -> list[tuple[Expr, list[float]]]:
    """The present values of place min(n - 1, p * n div 100) of each term."""
    out = []
    for s in range(0, len(terms), CHUNK):
        part = terms[s : s + CHUNK]
        cells = [frame.compile(e) for e in part]
        n = frame.df.agg(*(F.count(c) for c in cells)).first()
        asked = [[(min(k - 1, p * k // 100) + 0.5) / k for p in percentiles] if k else [0.5] for k in n]
        r = frame.df.agg(*(F.percentile_approx(c, a, ACCURACY).alias(f"t{i}") for i, (c, a) in enumerate(zip(cells, asked)))).first()
        out += [(e, sorted(set(r[f"t{i}"] or []))) for i, e in enumerate(part)]
    return [(e, v) for e, v in out if v]


def candidates(frame: Frame, target: str, config: TreeConfig) -> Candidates:
    tests = config.tests
    fields = [f for f in frame.df.schema.fields if f.name != target]
    plain: list[Expr] = [Col(f.name) == True for f in fields if isinstance(f.dataType, T.BooleanType)]  # noqa: E712
    plain += [fn.is_nothing(Col(f.name)) for f in fields if f.name not in frame.required and frame.has_missing(f.name)]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    if tests.text and text:
        from tessera.operators.stats import generic_percentiles

        for name in text:
            present = frame.filter_just(name)
            if present.df.limit(1).count():
                plain += [Col(name) == v for v in dict.fromkeys(generic_percentiles(present, (1, 25, 75, 99), name))]
    if tests.cross:
        numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType) and f.name not in frame.required and frame.has_missing(f.name)]
        for names, kinds in ((text, ("==",)), (numeric, ("<=", "=="))):
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    if tests.allows(a, b):
                        plain += [Col(a) <= Col(b) if k == "<=" else Col(a) == Col(b) for k in kinds]
    return Candidates(_thresholds(frame, numeric_terms(frame, tests, target), config.percentiles), plain)


# --- counting -----------------------------------------------------------------------------------


def _holds(frame: Frame, test: Expr) -> Column:
    return F.coalesce(frame.compile(test), F.lit(False))


def _counts(frame: Frame, place: Column, label: Column, tried: Candidates, n_labels: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """For each node number (place, none below 0) the counts of its labels, and (codes, labels) counts."""
    rows = frame.df.select(place.alias("__node"), label.cast("int").alias("__label"), tried.codes(frame).alias("__codes")).where("__node >= 0 and __label is not null")
    found = rows.select("__node", "__label", F.explode(F.concat(F.array(F.lit(-1)), "__codes")).alias("__code")).groupBy("__node", "__label", "__code").agg(F.count(F.lit(1)).alias("n"))
    own: dict[int, np.ndarray] = {}
    coded: dict[int, np.ndarray] = {}
    for r in found.collect():  # nodes * labels * codes rows at most
        node = r["__node"]
        if node not in own:
            own[node], coded[node] = np.zeros(n_labels, np.int64), np.zeros((tried.width(), n_labels), np.int64)
        if r["__code"] < 0:
            own[node][r["__label"]] = r["n"]
        else:
            coded[node][r["__code"], r["__label"]] = r["n"]
    return own, coded


def _combined(frame: Frame, place: Column, label: Column, best: dict[int, list[Expr]], n_labels: int, expansion: int) -> dict[int, list[tuple[Expr, np.ndarray]]]:
    """For each node its best tests and their combinations by `and` and `or`, with the label counts of
    the rows where each holds."""
    mask = F.lit(0)
    for node, tests in best.items():
        bits = reduce(lambda a, b: a + b, (_holds(frame, t).cast("int") * (1 << i) for i, t in enumerate(tests)))
        mask = F.when(place == node, bits).otherwise(mask)
    rows = frame.df.select(place.alias("__node"), label.cast("int").alias("__label"), mask.alias("__mask"))
    rows = rows.where(F.col("__node").isin(*best) & F.col("__label").isNotNull()).groupBy("__node", "__label", "__mask").agg(F.count(F.lit(1)).alias("n"))
    seen: dict[int, dict[int, np.ndarray]] = {node: {} for node in best}
    for r in rows.collect():  # nodes * labels * outcomes rows at most
        seen[r["__node"]].setdefault(r["__mask"], np.zeros(n_labels, np.int64))[r["__label"]] = r["n"]
    out = {}
    for node, tests in best.items():
        masks = np.array(list(seen[node]), dtype=np.int64)
        counts = np.array(list(seen[node].values())).reshape(len(masks), n_labels)
        base = [(t, masks >> i & 1 == 1) for i, t in enumerate(tests)]
        all_, now = list(base), base
        for _ in range(1, expansion):
            now = [pair for a, x in now for b, y in base if not a.same(b) for pair in ((a & b, x & y), (a | b, x | y))]
            all_ += now
        out[node] = [(e, counts[hit].sum(axis=0)) for e, hit in all_]
    return out


def gini(counts) -> np.ndarray | float:
    """Smoothed impurity of label counts, by the last axis; labels that are not there don't count."""
    c = np.asarray(list(counts.values()) if isinstance(counts, dict) else counts, dtype=float)
    n, k = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
    p = np.where(c > 0, (c + 1) / np.maximum(n + k, 1), 0.0)
    return np.where(n[..., 0] > 0, 1 - (p * p).sum(axis=-1), 0.0)


def majority(counts: dict):
    """Most frequent label, of equally frequent ones the largest."""
    return max(counts, key=lambda v: (counts[v], v))


def _most(counts: np.ndarray, labels: list):
    return majority(dict(zip(labels, counts.tolist())))


# --- growth -------------------------------------------------------------------------------------


def _placed(frame: Frame, tree: Node | Leaf, depth: int) -> tuple[Column, list[Node | Leaf]]:
    """The number of the node at `depth` that a row comes to (-1 if it ends above), and the nodes."""
    nodes: list[Node | Leaf] = []

    def walk(t: Node | Leaf, left: int) -> Column:
        if not left:
            nodes.append(t)
            return F.lit(len(nodes) - 1)
        if isinstance(t, Leaf):
            return F.lit(-1)
        return F.when(_holds(frame, t.test), walk(t.yes, left - 1)).otherwise(walk(t.no, left - 1))

    return walk(tree, depth), nodes


def _replaced(tree: Node | Leaf, depth: int, new: list[Node | Leaf]) -> Node | Leaf:
    """The tree with other nodes at `depth`, in the order of `_placed`."""
    later = iter(new)

    def walk(t: Node | Leaf, left: int) -> Node | Leaf:
        if not left:
            return next(later)
        return t if isinstance(t, Leaf) else Node(t.test, walk(t.yes, left - 1), walk(t.no, left - 1))

    return walk(tree, depth)


def labels_of(frame: Frame, target: str) -> list:
    found = [r[0] for r in frame.df.select(frame._c(target)).where(frame._c(target).isNotNull()).distinct().limit(MAX_LABELS + 1).collect()]
    if not found:
        raise EmptyData("there are no labels to learn from")
    if len(found) > MAX_LABELS:
        raise TypeMismatch(f"column '{target}' has more than {MAX_LABELS} labels")
    return sorted(found)


def fit_tree(frame: Frame, target: str, config: TreeConfig | None = None) -> Node | Leaf:
    config = config or TreeConfig()
    frame.check(target)
    labels = labels_of(frame, target)
    frame = frame.filter_just(target)
    tried = candidates(frame, target, config)
    return prune_dead(_refine(frame, target, tried, _greedy(frame, target, tried, labels, config), labels, config))


def _label_number(frame: Frame, target: str, labels: list) -> Column:
    return F.array_position(F.array(*(F.lit(v) for v in labels)), frame._c(target)) - 1


def _chosen(tests: list[Expr], score: np.ndarray, fine: np.ndarray, most: int) -> list[Expr]:
    """The best of the fine tests: by score, then the smaller, then the earlier."""
    order = sorted(np.flatnonzero(fine).tolist(), key=lambda i: (-score[i], size(tests[i]), i))
    return [tests[i] for i in order[:most]]


def _greedy(frame: Frame, target: str, tried: Candidates, labels: list, config: TreeConfig) -> Node | Leaf:
    tests, label = tried.tests(), _label_number(frame, target, labels)
    cost = config.tests.penalty * np.array([size(t) for t in tests])
    tree: Node | Leaf = Leaf(None)

    def gain(all_: np.ndarray, yes: np.ndarray) -> np.ndarray:
        """Impurity that splits take away; less than 0 where a side gets too few rows."""
        no = all_ - yes
        a, b = yes.sum(axis=-1), no.sum(axis=-1)
        lost = gini(all_) - (a * gini(yes) + b * gini(no)) / all_.sum()
        return np.where(np.minimum(a, b) >= config.min_leaf, lost, -1.0)

    for depth in range(config.max_depth + 1):
        place, nodes = _placed(frame, tree, depth)
        own, coded = _counts(frame, place, label, tried if depth < config.max_depth else Candidates([], []), len(labels))
        best = {}
        for i in own:
            if depth < config.max_depth and own[i].sum() > config.min_split and tests:
                found = gain(own[i], tried.held(coded[i]))
                picked = _chosen(tests, found - cost, found > 1e-12, config.pairs)
                if picked:
                    best[i] = picked
        split = _combined(frame, place, label, best, len(labels), config.tests.expansion) if best else {}
        new: list[Node | Leaf] = []
        for i in range(len(nodes)):
            found = [(e, float(gain(own[i], yes))) for e, yes in split.get(i, [])]
            found = [(e, g - config.tests.penalty * size(e)) for e, g in found if g >= 0]
            if found:
                test = max(found, key=lambda f: (f[1], -size(f[0])))[0]
                new.append(Node(test, Leaf(None), Leaf(None)))
            else:
                new.append(Leaf(_most(own[i] if i in own else np.zeros(len(labels), np.int64), labels)))
        tree = _replaced(tree, depth, new)
        if not split:
            break
    return tree


def to_expr(tree: Node | Leaf) -> Expr:
    return Lit(tree.value) if isinstance(tree, Leaf) else If(tree.test, to_expr(tree.yes), to_expr(tree.no))


def prune(e: Expr) -> Expr:
    """Conditionals with equal branches become the branch, and a branch that asks again what its
    conditional has just decided becomes what that gives."""
    if not isinstance(e, If):
        return e
    yes, no = prune(e.then), prune(e.other)
    if yes.same(no):
        return yes
    if isinstance(yes, If) and yes.test.same(e.test):
        yes = yes.then
    elif isinstance(no, If) and no.test.same(e.test):
        no = no.other
    return If(e.test, yes, no)


def prune_dead(tree: Node | Leaf) -> Node | Leaf:
    """Nodes whose branches are leaves of one value become that leaf."""
    if isinstance(tree, Leaf):
        return tree
    yes, no = prune_dead(tree.yes), prune_dead(tree.no)
    return yes if isinstance(yes, Leaf) and isinstance(no, Leaf) and yes.value == no.value else Node(tree.test, yes, no)


def depth(tree: Node | Leaf) -> int:
    return 0 if isinstance(tree, Leaf) else 1 + max(depth(tree.yes), depth(tree.no))


def loss(frame: Frame, target: str, tree: Node | Leaf) -> float:
    """Share of rows that the tree gets wrong."""
    wrong = ~frame.compile(to_expr(tree)).eqNullSafe(frame._c(target))
    return frame.df.agg(F.avg(wrong.cast("int"))).first()[0] or 0.0


# --- refinement ---------------------------------------------------------------------------------


def _refine(frame, target, tried, tree, labels, config) -> Node | Leaf:
    best = loss(frame, target, tree)
    for _ in range(config.iterations):
        if isinstance(tree, Leaf):
            break
        new = tree
        for level in range(depth(tree), -1, -1):
            new = _refined_level(frame, target, tried, new, level, labels, config)
        now = loss(frame, target, new)
        if now > best:  # smaller leaves can cost rows
            break
        tree, gained, best = new, best - now, now
        if gained <= config.tolerance:
            break
    return tree


#: Whether the branches of a row's node give its label: only the first, only the second, both or neither.
_FIRST, _SECOND, _SAME = 0, 1, 2


def _refined_level(frame, target, tried: Candidates, tree, level: int, labels, config) -> Node | Leaf:
    place, nodes = _placed(frame, tree, level)
    if not nodes:
        return tree
    inner = [i for i, t in enumerate(nodes) if isinstance(t, Node)]
    state = F.lit(_SAME)
    for i in inner:
        a, b = (frame.compile(to_expr(t)).eqNullSafe(frame._c(target)) for t in (nodes[i].yes, nodes[i].no))
        state = F.when(place == i, F.when(a & ~b, _FIRST).when(b & ~a, _SECOND).otherwise(_SAME)).otherwise(state)
    tests = tried.tests()
    changed = list(nodes)
    if inner and tests:
        own, coded = _counts(frame, F.when(place.isin(*inner), place).otherwise(F.lit(-1)), state, tried, 3)
        cost = np.floor(config.tests.penalty * np.array([size(t) for t in tests]))
        best = {}
        for i in own:
            if own[i][_FIRST] + own[i][_SECOND]:
                yes = tried.held(coded[i])
                sides = yes.sum(axis=1)
                fine = np.minimum(sides, own[i].sum() - sides) >= config.min_leaf
                picked = _chosen(tests, -(_errors(own[i], yes) + cost), fine, config.pairs)
                best[i] = [nodes[i].test, *(t for t in picked if not t.same(nodes[i].test))]
        for i, found in (_combined(frame, place, state, best, 3, config.tests.expansion) if best else {}).items():
            scored = [(e, int(_errors(own[i], yes)) + int(config.tests.penalty * size(e)), min(yes.sum(), own[i].sum() - yes.sum())) for e, yes in found]
            now = scored[0]
            better = min((s for s in scored if s[2] >= config.min_leaf), key=lambda s: s[1], default=now)
            if better[1] < now[1]:
                changed[i] = Node(better[0], nodes[i].yes, nodes[i].no)
    # Leaves, and nodes of which a branch gets too few rows, take the majority of the rows they get.
    side = F.lit(0)
    for i in inner:
        side = F.when(place == i, _holds(frame, changed[i].test).cast("int")).otherwise(side)
    by = frame.df.groupBy(place.alias("__node"), side.alias("__side"), _label_number(frame, target, labels).cast("int").alias("__label")).agg(F.count(F.lit(1)).alias("n")).where("__node >= 0")
    rows = np.zeros((len(nodes), 2, len(labels)), np.int64)
    for r in by.collect():  # nodes * labels * 2 rows at most
        rows[r["__node"], r["__side"], r["__label"]] = r["n"]
    for i, t in enumerate(changed):
        all_ = rows[i].sum(axis=0)
        if all_.sum() and (isinstance(t, Leaf) or rows[i].sum(axis=1).min() < config.min_leaf):
            changed[i] = Leaf(_most(all_, labels))
    return _replaced(tree, level, changed)


def _errors(own: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """Rows sent to the branch that is wrong for them while the other is right."""
    return yes[..., _SECOND] + own[_FIRST] - yes[..., _FIRST]


def fit(frame: Frame, target: str, config: TreeConfig | None = None) -> Expr:
    """The fitted tree as a pruned expression."""
    return prune(to_expr(fit_tree(frame, target, config)))
