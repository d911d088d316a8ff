"""Substring dedup: repeated word windows, found by an FM-index per shard.

A window is WINDOW consecutive words of one document. A word is removed if a window covers it whose
words also start in a document with a smaller doc_id.

Every window has an anchor, the least hash of its GRAM-word pieces, so equal windows have equal
anchors. Consecutive windows of one anchor are a run (cut at RUN windows, which only periodic texts
reach), and a run's words a segment.
1. Anchors that stand in two documents or more are found by an aggregation with map-side combining.
2. Documents meet the runs of such anchors; their segments are collapsed to distinct ones with the
   least and greatest doc_id of each, so copies cost one segment however many they are.
3. Distinct segments are dealt to shards by anchor. A shard's task builds the FM-index of its segments
   and streams them through it: backward search over the wavelet matrix gives matching statistics,
   and where they reach WINDOW words, the least doc_id of the matching interval.
   The segments of an anchor with more than CELL words are cut anew at runs of a second anchor, made by
   another hash of longer pieces, collapsed and dealt out by both, and so on (PIECES): windows that
   differ part, and those that are equal become one segment. The last pieces are whole windows, so no
   shard grows without bound; what is left for them, the index finds as single windows.
4. The intervals found meet the documents again.

Frequent anchors and segments meet their few rows by a broadcast, so that no key's rows are gathered.
Words are compared by 48-bit hashes inside a window; segments are one if their 64-bit hashes and their
anchors' are equal.

Edge cases: null texts have no words; rows without doc_id come after all others and never remove words
from each other; rows that share a doc_id do not remove words from each other; repeated rows are
answered alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared, textkit
from tessera.llm.fm_index import FMIndex

WINDOW, GRAM = 13, 5
#: Windows of a run at most.
RUN = 64
#: Words of one anchor's distinct segments that stay together, and words of the pieces that make the
#: anchors of larger ones.
CELL, PIECES = 25_000, (8, 10, 11, 12, 12, 12, 12, WINDOW)
#: Words of distinct segments in a shard, about.
SHARD_WORDS = 100_000
#: Rows of one key from which it meets its other side by a broadcast.
HOT_ROWS = 100_000
#: Segments that a task remembers to have told the words of.
TOLD = 1 << 20
LAST = np.iinfo(np.int64).max


def _least_of(grams: np.ndarray, n: int, size: int) -> np.ndarray:
    """The least of the pieces of `size` words of the window at each of n words."""
    least = grams[:n].copy()
    for j in range(1, WINDOW - size + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return least


def _runs(anchor: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where a run of equal anchors in a row begins, its windows), cut at RUN windows."""
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    begin = np.flatnonzero(new)
    if len(begin):
        new |= (np.arange(len(anchor)) - begin[np.cumsum(new) - 1]) % RUN == 0
        begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(anchor)))


def runs_of(words: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first window as a word number in its row, windows, run number in its row)."""
    h = words.hashes()
    least = _least_of(textkit.ngrams(h, GRAM), max(0, len(h) - WINDOW + 1), GRAM)
    at, rows = textkit.ngram_rows(words.first, WINDOW)
    begin, size = _runs(least[at], rows)
    row = rows[begin]
    number = np.arange(len(begin)) - np.searchsorted(row, row)
    return row, least[at][begin], at[begin] - words.first[row], size, number


def _keys(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of the words flat[bounds[i]:bounds[i + 1]] of each segment."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(flat) * textkit._power(textkit._BASE, len(flat))[: len(flat)])])
    own = (total[bounds[1:]] - total[bounds[:-1]]) * textkit._power(textkit._INVERSE, len(flat))[bounds[:-1]]
    return textkit.mix(own + np.diff(bounds).astype(np.uint64))


class Told:
    """Which segments a task has told the words of; forgets all when it holds TOLD of them."""

    def __init__(self):
        self.seen = np.zeros(0, np.uint64)

    def new(self, keys: np.ndarray) -> np.ndarray:
        kinds, first = np.unique(keys, return_index=True)
        first = first[~np.isin(kinds, self.seen, assume_unique=True)]
        self.seen = np.union1d(self.seen, kinds) if len(self.seen) < TOLD else kinds
        out = np.zeros(len(keys), dtype=bool)
        out[first] = True
        return out


def _words_array(flat: np.ndarray, bounds: np.ndarray, told: np.ndarray) -> pa.Array:
    """The packed words of the segments that are told, null for the others."""
    long = np.diff(bounds)
    raw = _pack(flat[textkit.spread(bounds[:-1][told], long[told])])
    at = np.concatenate([[0], np.cumsum(np.where(told, long, 0))]) * _BYTES
    return pa.Array.from_buffers(pa.binary(), len(long), [pa.py_buffer(np.packbits(told, bitorder="little").tobytes()), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])


_BYTES = 6  # of a word's hash in a segment


def _pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def _unpack(raw) -> np.ndarray:
    out = np.zeros((len(raw) // _BYTES, 8), dtype=np.uint8)
    out[:, :_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _BYTES)
    return out.reshape(-1).view("<u8")


def _documents(docs: DataFrame) -> DataFrame:
    """id (a missing one is LAST), print and text of every row. print tells the rows of one id apart: a
    hash of the text where some id repeats, else 0, which takes no room in the tables below."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    several = not ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    mark = F.xxhash64(text) if several else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), mark.alias("print"), text.alias("text"))


def _emit_anchors(batches):
    for batch in textkit.chunks(batches, "text"):
        row, anchor, _, _, _ = runs_of(textkit.Words(batch.column(1)))
        if not len(row):
            continue
        ids = np.asarray(batch.column(0))[row]
        order = np.lexsort((ids, anchor))
        anchor, ids = anchor[order], ids[order]
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        stop = np.append(edge[1:], len(anchor))
        yield pa.RecordBatch.from_arrays([pa.array(anchor[edge].view(np.int64)), pa.array(ids[edge]), pa.array(ids[stop - 1]), pa.array(stop - edge)], names=["anchor", "lo", "hi", "n"])


def _emit_runs(batches):
    for batch in textkit.chunks(batches, "text"):
        row, anchor, _, _, number = runs_of(textkit.Words(batch.column(2)))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(number.astype(np.int32))], names=["anchor", "id", "print", "run"])


_SEGMENTS = "anchor long, key long, id long, print long, start int, words binary"


def _emit_segments(batches):
    """Segments of the wanted runs; the words only where a segment stands first in the task, about."""
    told = Told()
    for batch in textkit.chunks(batches, "text"):
        words = textkit.Words(batch.column(2))
        h = words.hashes()
        row, anchor, start, size, number = runs_of(words)
        own = np.searchsorted(row, np.arange(batch.num_rows))
        wanted = batch.column(3)
        counts = np.diff(np.asarray(wanted.offsets))
        picked = own[np.repeat(np.arange(batch.num_rows), counts)] + np.asarray(wanted.flatten()).astype(np.int64)
        row, anchor, start, size = row[picked], anchor[picked], start[picked], size[picked]
        long = size + WINDOW - 1
        flat, bounds = h[textkit.spread(words.first[row] + start, long)], np.concatenate([[0], np.cumsum(long)])
        key = _keys(flat, bounds)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(key.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(start.astype(np.int32)), _words_array(flat, bounds, told.new(key ^ textkit.mix(anchor)))], names=[c.split()[0] for c in _SEGMENTS.split(", ")])


def _segments(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds) of packed segments."""
    where = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return _unpack(column.buffers()[2][int(where[0]) : int(where[-1])]), (where - where[0]) // _BYTES


_CUT = "above_anchor long, above_key long, place int, anchor long, key long, lo long, hi long, words binary"


def _cutting(level: int):
    """Cuts (anchor, key, lo, hi, words) at the runs of another anchor, which joins the one before."""

    def run(batches):
        told = Told()
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                flat, first = _segments(part.column(4))
                grams = textkit.mix(textkit.ngrams(flat, PIECES[level]) + np.uint64(level + 1))
                least = _least_of(grams, max(0, len(flat) - WINDOW + 1), PIECES[level])
                at_, rows = textkit.ngram_rows(first, WINDOW)
                begin, size = _runs(least[at_], rows)
                row, start = rows[begin], at_[begin]
                above = np.asarray(part.column(0)).view(np.uint64)[row]
                anchor = textkit.mix(above + textkit.mix(least[start]))
                words, bounds = flat[textkit.spread(start, size + WINDOW - 1)], np.concatenate([[0], np.cumsum(size + WINDOW - 1)])
                key = _keys(words, bounds)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), part.column(1).take(take), pa.array((start - first[row]).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(key.view(np.int64)),
                    part.column(2).take(take), part.column(3).take(take), _words_array(words, bounds, told.new(key ^ textkit.mix(anchor))),
                ], names=[c.split()[0] for c in _CUT.split(", ")])

    return run


def _search_shard(table: pa.Table) -> pa.Table:
    """anchor, key, n, i, j, least: the windows i..j of a segment that start in document `least` first,
    where that is before the last document of the segment."""
    table = table.combine_chunks()
    anchor, key, lo, hi, n = (np.asarray(table.column(c)) for c in ("anchor", "key", "lo", "hi", "n"))
    raw = table.column("words").combine_chunks()
    flat, bounds = _segments(raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw)
    index = FMIndex(flat, bounds, WINDOW + 1)
    length, low, high = index.matching_statistics(flat, bounds, WINDOW, least=WINDOW, own=True)
    found = np.flatnonzero(length == WINDOW)
    least = index.least(low[found], high[found], lo)
    owner = np.searchsorted(bounds, found, side="right") - 1
    place = found - bounds[owner] - WINDOW + 1
    use = least < hi[owner]
    owner, place, least = owner[use], place[use], least[use]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(owner)) - 1 if len(begin) else begin
    own = owner[begin]
    del index, flat
    textkit.give_back()
    return pa.table({"anchor": anchor[own], "key": key[own], "n": n[own], "i": place[begin].astype(np.int32), "j": place[end].astype(np.int32), "least": least[begin]})


_FOUND = "anchor long, key long, n long, i int, j int, least long"


def _search(cells: DataFrame) -> DataFrame:
    total = cells.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)) / _BYTES).first()[0]
    dealt = cells.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(1, int(total // SHARD_WORDS)))))
    return dealt.groupBy("shard").applyInArrow(_search_shard, _FOUND)


def _meet(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with other(keys, n), n being the rows of a key: keys of many rows by a broadcast (they
    are few), all others by a shuffle."""
    hot = other.where(F.col("n") > HOT_ROWS)
    if hot.limit(1).count() == 0:
        return rows.join(other.drop("n"), keys)
    hot = F.broadcast(hot.drop("n"))
    cool = rows.join(hot.select(*keys).distinct(), keys, "left_anti").join(other.where(F.col("n") <= HOT_ROWS).drop("n"), keys)
    return rows.join(hot, keys).unionByName(cool)


def _collapsed(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """anchor, key, lo, hi, n, words of the distinct segments."""
    return rows.groupBy("anchor", "key").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n"), F.first("words", ignorenulls=True).alias("words"))


def _finish(batches):
    for batch in textkit.chunks(batches, "text"):
        words = textkit.Words(batch.column(1))
        cover = batch.column(2)
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        lists = np.asarray(cover.offsets)
        spans = cover.flatten()
        first = np.repeat(words.first[:-1], np.diff(lists))
        np.add.at(gone, first + np.asarray(spans.field("s")), 1)
        np.add.at(gone, first + np.asarray(spans.field("e")), -1)
        keep = np.cumsum(gone)[:-1] == 0
        n_words, removed, digests = np.diff(words.first), [], []
        for a, b in zip(words.first[:-1], words.first[1:]):
            kept = np.flatnonzero(keep[a:b]) + a
            removed.append(b - a - len(kept))
            size = words.ends[kept] - words.starts[kept] + 1
            text = words.data[np.minimum(textkit.spread(words.starts[kept], size), len(words.data) - 1)]
            text[np.cumsum(size) - 1] = 0x20
            digests.append(hashlib.sha256(text[:-1].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(removed, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _matches(distinct: DataFrame, drop: list[str]) -> DataFrame:
    """What _search_shard finds in all distinct segments; `drop` gets the paths of the tables in use."""
    levels, cells = [], distinct  # (segments, what was found in them, what they were cut to)
    for level in range(len(PIECES) + 1):
        large = cells.groupBy("anchor").agg(F.sum(F.octet_length("words")).alias("size")).where(F.col("size") > CELL * _BYTES).select("anchor")
        large = shared.materialise(large, "substring-large")
        if level == len(PIECES) or large.isEmpty():
            levels.append((cells, _search(cells), None))
            break
        kept = shared.materialise(_search(cells.join(large, "anchor", "left_anti")), "substring-found")
        cut = cells.join(large, "anchor", "left_semi").select("anchor", "key", "lo", "hi", "words").mapInArrow(textkit.tidy(_cutting(level)), _CUT)
        cut, path = shared.store(cut, "substring-cut")
        levels.append((cells, kept, cut))
        cells, other = shared.store(_collapsed(cut, "lo", "hi"), "substring-distinct")
        drop += [path, other]
    _, out, _ = levels.pop()
    for cells, kept, cut in reversed(levels):
        up = _meet(cut.select("above_anchor", "above_key", "place", "anchor", "key"), shared.materialise(out, "substring-found"), ["anchor", "key"])
        up = up.select(F.col("above_anchor").alias("anchor"), F.col("above_key").alias("key"), (F.col("i") + F.col("place")).alias("i"), (F.col("j") + F.col("place")).alias("j"), "least")
        out = kept.unionByName(up.join(cells.select("anchor", "key", "n"), ["anchor", "key"]))
    return out


def repeated_spans(rows: DataFrame) -> DataFrame:
    """id, print, cover: for rows of `_documents` the word spans [s, e) that earlier ones hold."""
    spark = rows.sparkSession
    anchors = rows.select("id", "text").mapInArrow(_emit_anchors, "anchor long, lo long, hi long, n long")
    several = anchors.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi").select("anchor", "n")
    several = shared.materialise(several, "substring-anchors")
    runs = rows.select("id", "print", "text").mapInArrow(_emit_runs, "anchor long, id long, print long, run int")
    wanted = shared.materialise(_meet(runs, several, ["anchor"]).groupBy("id", "print").agg(F.collect_set("run").alias("runs")), "substring-runs")

    segments = rows.join(wanted, ["id", "print"]).select("id", "print", "text", "runs").mapInArrow(_emit_segments, _SEGMENTS)
    segments, all_path = shared.store(segments, "substring-segments")
    distinct, distinct_path = shared.store(_collapsed(segments, "id", "id"), "substring-distinct")
    places = shared.materialise(segments.select("anchor", "key", "id", "print", "start"), "substring-places")
    shared.drop(spark, all_path)
    paths = [distinct_path]
    found = shared.materialise(_matches(distinct, paths), "substring-matches")
    for path in paths:
        shared.drop(spark, path)
    spans = _meet(places, found, ["anchor", "key"]).where("least < id")
    span = F.struct((F.col("start") + F.col("i")).alias("s"), (F.col("start") + F.col("j") + WINDOW).alias("e"))
    return shared.materialise(spans.groupBy("id", "print").agg(F.collect_list(span).alias("cover")), "substring-spans")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs(doc_id, text)."""
    rows = _documents(docs)
    rows = rows.join(repeated_spans(rows), ["id", "print"], "left")
    none = F.array().cast("array<struct<s:int,e:int>>")
    return rows.select(F.nullif("id", F.lit(LAST)).alias("doc_id"), "text", F.coalesce("cover", none).alias("cover")).mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
