"""MinHash near-duplicates with circulant permutations.

Two permutations of the 32-bit numbers make all signature coordinates: shingles go through the first,
and coordinate k is the least value of the second one shifted circularly by k. Bands of ROWS
coordinates give candidates, whose Jaccard similarity is then computed on the full shingle sets.

Documents of equal shingle sets are one node from the start, named by a number of its own, so a doc_id
that stands on several texts has several nodes; these are linked, as they are one document. In a
bucket every node is compared with the bucket's leader, the node that shares the most buckets with
others (so the text that many copies were made of, if it is there); after these links are merged, only
nodes of different components in the same bucket are left, and of those only pairs that the set sizes, the
triangle inequality of the Jaccard distance (known to the bucket's leader) and a sketch of the
signatures leave open are compared. So a group of copies costs one comparison a copy and leader, and
no product of its members. The nodes left of a bucket are dealt to cells by their sets' sizes, and a
cell of more than CELL nodes over several tasks.

A pair at the threshold shares no band with a probability below MISSED; the sketch (WIDE coordinates,
2 bits of each) rejects one with a probability below 1e-8. Nothing else is lost.

Edge cases: null and wordless texts have no shingles, are linked with nothing and kept; texts of fewer
words than a shingle has are one shingle; rows that share a doc_id are one document with several texts,
so whatever is linked with one of them is linked with all; repeated rows are answered alike; rows
without doc_id are linked with nothing and kept; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared, textkit
from tessera.llm.graph import MOST_HUBS, components, lowered

#: Coordinates in a band, and the probability that a pair at the threshold shares no band.
ROWS, MISSED = 5, 1.4e-6
#: Coordinates of a sketch.
WIDE = 1024
#: Members of a leader that one task compares before the next salt begins.
FAN = 64
#: Nodes of a bucket and size class that are held against each other under one key, about.
CELL = 512
#: Nodes of a component from which it meets its least doc_id by a broadcast.
LARGE = 1000


@dataclass(frozen=True)
class Likeness:
    """Documents are linked if 100 * intersection >= percent * union of their shingles of `size` words."""

    size: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return ceil(log(MISSED) / log(1 - (self.percent / 100) ** ROWS))

    @property
    def gap(self) -> int:
        """In how many coordinates the sketches of a linked pair may differ: six deviations above the
        number expected at the threshold."""
        q = 0.75 * (1 - self.percent / 100)
        return ceil(WIDE * q + 6 * sqrt(WIDE * q * (1 - q)))

    def linked(self) -> Column:
        return 100 * F.col("common") >= self.percent * F.col("total")


_first = np.random.default_rng(7).integers(0, 1 << 63, dtype=np.uint64) | np.uint64(1)
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)  # odd


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of row i are hashes[bounds[i]:bounds[i + 1]]."""
    words = textkit.Words(column, lower=True)
    h = words.hashes()
    count = np.diff(words.first)
    at, rows = textkit.ngram_rows(words.first, size)
    values = textkit.ngrams(h, size)[at]
    for short in range(1, size):  # the whole sequence of a shorter text
        own = np.flatnonzero(count == short)
        few = np.zeros(len(own), np.uint64)
        for j in range(short):
            few = few * np.uint64(0x9FB21C651E98DF25) + h[words.first[own] + j]
        values = np.concatenate([values, textkit.mix(few + np.uint64(short))])
        rows = np.concatenate([rows, own])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])])
        values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(count) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """(rows with shingles, size) circulant MinHash coordinates."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), size), dtype=np.uint32)
    if not len(full):
        return out
    at = (textkit.mix(values * _first) >> np.uint64(32)).astype(np.uint32) * _A  # the first permutation
    x, high = np.empty_like(at), np.empty_like(at)
    for k in range(size):  # the second one: every step is a bijection of what the shift by k gives
        np.add(at, np.uint32(k * int(_A) & 0xFFFFFFFF), out=x)
        np.right_shift(x, np.uint32(16), out=high)
        np.bitwise_xor(x, high, out=x)
        np.multiply(x, _B, out=x)
        np.right_shift(x, np.uint32(13), out=high)
        np.bitwise_xor(x, high, out=x)
        np.multiply(x, _C, out=x)
        out[:, k] = np.minimum.reduceat(x, bounds[full])
    return out


def _band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), dtype=np.uint64)
    for r in range(ROWS):
        keys = textkit.mix(keys + sig[:, r::ROWS].astype(np.uint64) + np.uint64(1))
    return textkit.mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def sketches(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, sketch (longs with the low 2 bits of WIDE coordinates) of the named nodes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = [np.frombuffer(x, dtype=np.uint64) for x in part.column(1).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
                pairs = (signatures(np.concatenate(raw), bounds, WIDE) * _A >> np.uint32(30)).astype(np.uint8).reshape(len(raw), -1, 4)
                packed = (pairs[:, :, 0] | pairs[:, :, 1] << 2 | pairs[:, :, 2] << 4 | pairs[:, :, 3] << 6).astype(np.uint8).view("<i8")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * packed.shape[1], pa.int32()), pa.array(packed.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "sketch"])

    return sets.join(nodes, "node", "left_semi").select("node", "shingles").mapInArrow(textkit.tidy(run), "node long, sketch array<long>")


def sketch_gap(a: Column, b: Column) -> Column:
    """Coordinates in which two sketches differ."""
    gap = F.lit(0)
    for i in range(WIDE // 32):
        x = a[i].bitwiseXOR(b[i])
        gap = gap + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return gap


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each row's shingles."""
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        total = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(values ^ np.uint64(salt)))])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("print"), text.alias("text"))


def describe(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, print (of the text), n, f1, f2 (fingerprint of the shingle set), bands."""

    def run(batches):
        for batch in textkit.chunks(batches, "text"):
            values, bounds = shingle_sets(batch.column(2), like.size)
            n = np.diff(bounds)
            size = np.where(n > 0, like.bands, 0)
            keys = _band_keys(signatures(values, bounds, like.bands * ROWS), like.bands)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *map(pa.array, fingerprints(values, bounds)), bands], names=["doc_id", "print", "n", "f1", "f2", "bands"])

    return _rows(docs).mapInArrow(run, "doc_id long, print long, n long, f1 long, f2 long, bands array<long>")


def node_sets(docs: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """node, shingles (sorted 64-bit hashes as bytes) of nodes(node, doc, print, f1, f2).

    Each is read from the row that stands for it; repeats of that row in a task count once.
    """
    asked = nodes.select("node", F.col("doc").alias("doc_id"), "print", "f1", "f2").hint("shuffle_hash")

    def run(batches):
        done = set()
        for batch in textkit.chunks(batches, "text"):
            values, bounds = shingle_sets(batch.column(0), like.size)
            f1, f2 = fingerprints(values, bounds)
            same = (f1 == np.asarray(batch.column(2))) & (f2 == np.asarray(batch.column(3)))
            ids, raw = [], []
            for i, node in enumerate(batch.column(1).to_pylist()):
                if same[i] and node not in done:
                    done.add(node)
                    ids.append(node)
                    raw.append(values[bounds[i] : bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["node", "shingles"])

    return _rows(docs).join(asked, ["doc_id", "print"]).select("text", "node", "f1", "f2").mapInArrow(run, "node long, shingles binary")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common, total: sizes of intersection and union for distinct pairs(a, b).

    All pairs of a b go to tasks that read the set of b once and then those of the a; a b with many
    pairs is dealt out over salts of about FAN pairs each.
    """
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("pairs")).withColumn("salts", F.ceil(F.col("pairs") / FAN))
    lead = many.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).hint("shuffle_hash").join(sets.withColumnRenamed("node", "b"), "b")
    lead = lead.select("b", "salt", F.lit(None).cast("long").alias("a"), "shingles")
    rest = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt")).hint("shuffle_hash").join(sets.withColumnRenamed("node", "a"), "a")
    rows = lead.unionByName(rest.select("b", "salt", "a", "shingles")).repartition("b", "salt").sortWithinPartitions("b", "salt", "a")

    def run(batches):
        now, own = None, None
        for batch in batches:
            out = []
            for b, salt, a, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                mine = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if a is None:  # null sorts first: the leader itself
                    now, own = (b, salt), mine.copy()
                    continue
                assert now == (b, salt)
                at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                common = int((own[at] == mine).sum())
                out.append((a, b, common, len(own) + len(mine) - common))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "common", "total"])

    return rows.select("b", "salt", "a", "shingles").mapInArrow(textkit.tidy(run), "a long, b long, common long, total long")


def _open_pairs(open_nodes: DataFrame, like: Likeness) -> DataFrame:
    """a, b: the pairs of one bucket and different components that need a comparison.

    open_nodes: bucket, band, node, n, d (distance to the bucket's leader), root, sketch, bands.
    Linked sets differ in size by less than a class, so a node meets the cells of three classes; the
    blocks of a cell of more than CELL nodes are dealt out in pairs.
    """
    reach = 1 - like.percent / 100 + 1e-9
    classed = open_nodes.withColumn("class", F.floor(F.log("n") / F.lit(-log(like.percent / 100) + 1e-9)))
    y = classed.where("d > 0")
    x = classed.where(F.col("d") > reach).select("bucket", *(F.col(c).alias(f"{c}_x") for c in ("node", "n", "d", "root", "sketch", "bands")), F.explode(F.array(*(F.col("class") + i for i in (-1, 0, 1)))).alias("class"))
    loads = x.select("bucket", "class").unionByName(y.select("bucket", "class")).groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("load"))
    large = F.broadcast(loads.where(F.col("load") > CELL).withColumn("salts", F.ceil(F.col("load") / CELL)).drop("load"))  # at most a row for each CELL rows
    zero, last = F.lit(0).cast("long"), F.col("salts") - 1

    def salted(rows: DataFrame, node: str, own: str, other: str) -> DataFrame:
        """Every block of a large cell's x meets every block of its y under a key of its own."""
        rows = rows.join(large, ["bucket", "class"], "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
        return rows.withColumn(own, F.pmod(F.xxhash64(node), F.col("salts"))).withColumn(other, F.explode(F.sequence(zero, last))).drop("salts")

    x, y = salted(x, "node_x", "block_x", "block_y"), salted(y, "node", "block_y", "block_x")
    first = F.coalesce(*(F.when(F.col("bands")[i] == F.col("bands_x")[i], F.lit(i)) for i in range(like.bands)))  # a pair counts in its first common bucket
    near = (F.col("root") != F.col("root_x")) & (F.abs(F.col("d") - F.col("d_x")) <= reach) & ((F.col("d") <= reach) | (F.col("node") < F.col("node_x")))
    sizes = 100 * F.least("n", "n_x") >= like.percent * F.greatest("n", "n_x")
    alike = near & sizes & (first == F.col("band")) & (sketch_gap(F.col("sketch"), F.col("sketch_x")) <= like.gap)
    return x.join(y, ["bucket", "class", "block_x", "block_y"]).where(alike).select(F.col("node_x").alias("a"), F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    paths = []

    def step(df: DataFrame, name: str) -> DataFrame:
        """Written for the steps below; deleted at the end."""
        out, path = shared.store(df, f"minhash-{name}")
        paths.append(path)
        return out

    described = shared.materialise(describe(docs, like), "minhash")
    real = described.where("n > 0 and doc_id is not null")
    found = real.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "print")).alias("row"), F.min_by("bands", "doc_id").alias("bands"))
    nodes = shared.materialise(found.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n", F.col("row.doc_id").alias("doc"), F.col("row.print").alias("print"), "bands"), "minhash-nodes")
    members = shared.materialise(real.select("doc_id", "f1", "f2", "n").distinct().join(nodes.select("f1", "f2", "n", "node"), ["f1", "f2", "n"]).select("doc_id", "node"), "minhash-members")
    several = members.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").select("doc_id", "b")
    own = members.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")

    pieces = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    sizes = pieces.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = step(pieces.join(sizes, "bucket"), "buckets")
    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = buckets.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader"))
    buckets = step(buckets.drop("size").join(leaders, "bucket"), "leaders")
    stars = step(buckets.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    named = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    sets = step(node_sets(docs, nodes.drop("bands").join(named, "node", "left_semi"), like), "sets")
    known = step(compare(stars, sets), "compared")
    roots = components(known.where(like.linked()).select("a", "b").unionByName(own), "minhash-links")

    # What is left: nodes of one bucket in different components.
    far = known.select(F.col("a").alias("node"), F.col("b").alias("leader"), (1 - F.col("common") / F.col("total")).alias("d"))
    placed = buckets.join(far, ["node", "leader"], "left").join(roots, "node", "left")
    placed = placed.select("bucket", "band", "node", "n", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("root", "node").alias("root"))
    open_buckets = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    open_nodes = step(placed.join(open_buckets, "bucket"), "open")
    drawn = step(sketches(sets, open_nodes.select("node").distinct()), "sketches")
    more = step(_open_pairs(open_nodes.join(drawn, "node").join(nodes.select("node", "bands"), "node"), like), "more")
    if not more.isEmpty():
        later = step(compare(more, sets).where(like.linked()).select("a", "b"), "later")
        if not later.isEmpty():
            roots = components(later.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "minhash-all")

    for path in paths:
        shared.drop(docs.sparkSession, path)
    rooted = nodes.select("node", "doc").join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    least = shared.materialise(rooted.groupBy("root").agg(F.min("doc").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("root", "u"), "minhash-least")
    most = max(LARGE, least.count() // MOST_HUBS)
    named = lowered(rooted.select(F.col("root").alias("u"), F.col("node").alias("v")), least, most).select(F.col("v").alias("node"), F.col("m").alias("component_id"))
    placed = members.join(named, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = described.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component."""
    gone = near_duplicates(docs, like).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.gone"), "left_anti")
