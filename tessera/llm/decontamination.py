"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised (A-Z lower-cased, runs of ASCII characters other than letters and digits become
one space; lengths and edits count bytes). An item is cut into half-overlapping windows of WINDOW
bytes (a shorter item is one window). A document holds the item if some region of it aligns with one
of its windows with at most floor(EDIT_RATE * window length) edits.

The q-gram lemma: such a region shares at least w - Q + 1 - Q * e of the window's q-grams, on at most
e + 1 neighbouring diagonals. It misses at most Q * e of them, so of any S of a window's q-grams S - Q * e
are shared. Those of up to HOT postings are looked up in the documents, a bounded number of postings at a
time, and as many of the rarest others as make S exceed Q * e; so what a template gives to very many items
is mostly left out. Shared q-grams are counted in overlapping bands of diagonals; regions that reach the
bound (then that of all q-grams, where some were left out) are kept and verified by banded alignment, many
at once. Equal windows of many items are searched for once.

An item of fewer than MIN_BYTES normalised bytes is its own q-gram: Q is lowered to its length, where
the bound leaves no edits, and it is found wherever it stands whole between word borders.

Edge cases: null texts are empty and match nothing; an empty item matches nothing; repeated items and
documents give repeated rows; ids may be of any type; without items or documents the result is empty;
other columns are ignored by `find_leaks` and kept by `keep_clean`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit

Q, WINDOW, EDIT_RATE, MIN_BYTES = 10, 96, 0.06, 40
#: Diagonals of half a band; more than the edits of any window.
HALF_BAND = 8
#: Bytes of items in one index, which takes about 25 times as much memory; a larger benchmark is
#: searched in several passes.
BLOCK_BYTES = 8 << 20
#: Postings looked at in one go.
PIECE = 1 << 18
#: Postings of a q-gram up to which it is always looked up.
HOT = 64
#: Positions that the shared q-grams of a region lie apart at most.
REACH = WINDOW + WINDOW // 2 + 2 * HALF_BAND

_FOLD = np.array([0x20 if c < 0x80 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 0x80 else c for c in range(256)], dtype=np.uint8)


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the normalised texts; spaces at either end of a text go."""
    data, offsets = textkit.string_buffers(column)
    if not len(data):
        return data, offsets
    folded = _FOLD[data]
    gap = folded == 0x20
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1] & ~first[1:-1]  # the first space of a run, inside a text
    total = np.concatenate([[0], np.cumsum(keep)])
    out, at = folded[keep], total[offsets]
    last = np.flatnonzero(np.diff(at))  # a run at the end of a text has left one space
    tail = at[1:][last] - 1
    tail = tail[out[tail] == 0x20]
    if len(tail):
        drop = np.ones(len(out), dtype=bool)
        drop[tail] = False
        at = np.concatenate([[0], np.cumsum(drop)])[at]
        out = out[drop]
    return out, at


def _qgrams(data: np.ndarray) -> np.ndarray:
    return textkit.ngrams(textkit._LETTERS[data], Q)


@dataclass
class Index:
    """Different windows of a block of items, and the postings of their rarer q-grams, sorted by hash."""

    item_ids: pa.Array
    patterns: np.ndarray  # (windows, WINDOW + WINDOW // 2) bytes, zero-padded
    length: np.ndarray
    owner: np.ndarray  # item numbers, window by window
    owners: np.ndarray  # where those of each window begin
    grams: np.ndarray  # distinct hashes
    begin: np.ndarray  # postings of each hash
    window: np.ndarray
    place: np.ndarray
    need: np.ndarray  # q-grams with postings that a region must share with each window
    whole: np.ndarray  # whether all q-grams of a window have postings
    seen: np.ndarray  # by the low bits of a hash
    short: np.ndarray  # sorted hashes of short items
    short_item: np.ndarray
    short_sizes: np.ndarray  # lengths in use
    texts: list  # of short items, as bytes


def build_index(item_ids: pa.Array, texts: pa.Array) -> Index:
    data, at = normalise(texts)
    size, half, wide = np.diff(at), WINDOW // 2, WINDOW + WINDOW // 2
    long = np.flatnonzero(size >= MIN_BYTES)
    count = np.maximum(0, size[long] - WINDOW) // half + 1
    owner = np.repeat(long, count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length = np.where(number == np.repeat(count, count) - 1, size[owner] - number * half, WINDOW)
    first = at[owner] + number * half
    column = np.arange(wide)
    patterns = np.zeros((len(owner), wide), dtype=np.uint8)
    inside = column < length[:, None]
    patterns[inside] = data[(first[:, None] + column)[inside]]
    _, one, same = np.unique(patterns.view(f"V{wide}").reshape(-1), return_index=True, return_inverse=True)
    order = np.argsort(same, kind="stable")
    owners = np.searchsorted(same[order], np.arange(len(one) + 1))
    patterns, length, first, owner = patterns[one], length[one], first[one], owner[order]

    many = length - Q + 1
    hashes = _qgrams(data)[textkit.spread(first, many)] if len(one) else np.zeros(0, np.uint64)
    window, place = np.repeat(np.arange(len(one)), many), textkit.spread(np.zeros(len(one), np.int64), many)
    _, kind, times = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.lexsort((place, times[kind], window))  # in each window, the rarest first
    misses = Q * edits_allowed(length)
    taken = np.minimum(many, np.maximum(np.bincount(window, weights=times[kind] <= HOT, minlength=len(one)).astype(np.int64), misses + 1))
    rarest = order[textkit.spread(np.cumsum(many) - many, taken)]
    rarest = rarest[np.argsort(hashes[rarest], kind="stable")]
    grams, begin = np.unique(hashes[rarest], return_index=True)
    seen = np.zeros(1 << 22, dtype=bool)
    seen[(grams & np.uint64(len(seen) - 1)).astype(np.int64)] = True

    small = np.flatnonzero((size > 0) & (size < MIN_BYTES))
    own = textkit.span_hashes(data, at[small], at[small + 1])
    small, own = small[order := np.argsort(own, kind="stable")], own[order]
    kept = [data[at[i] : at[i + 1]].tobytes() for i in small]
    return Index(item_ids, patterns, length, owner, owners, grams, np.append(begin, len(rarest)), window[rarest].astype(np.int32), place[rarest].astype(np.int16), taken - misses, taken == many, seen, own, small, np.unique(size[small]), kept)


def edits_allowed(length: np.ndarray) -> np.ndarray:
    return np.floor(EDIT_RATE * length).astype(np.int64)


def banded_edits(text: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, patterns: np.ndarray, length: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against a region of its text, and where the region ends.

    Candidate k aligns patterns[k, :length[k]] with text[low[k]:high[k]], on the diagonals
    start[k] .. start[k] + spread - 1 (a diagonal is a text position for the pattern's first byte).
    Both ends of the region are free.
    """
    n = len(start)
    offsets = np.arange(spread)
    cost = np.zeros((n, spread), dtype=np.int32)
    best, end = np.full(n, 1 << 20, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(int(length.max()) if n else 0):
        at = start[:, None] + i + offsets
        inside = (at >= low[:, None]) & (at < high[:, None])
        same = inside & (text[np.clip(at, 0, max(len(text) - 1, 0))] == patterns[:, i][:, None])
        step = cost + ~same
        step[~inside] = 1 << 20
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - offsets, axis=1) + offsets
        done = np.flatnonzero(length == i + 1)
        if len(done):
            k = cost[done].argmin(axis=1)
            best[done], end[done] = cost[done, k], start[done] + i + 1 + k
    return best, end


def search(index: Index, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, item numbers, matched windows, least edits, end byte of that region) of all matches."""
    data, offsets = normalise(column)
    found = _short_items(index, data, offsets) if len(index.short) and len(data) else []
    if len(index.grams) and len(data) >= Q:
        h = _qgrams(data)
        at = np.flatnonzero(index.seen[(h & np.uint64(len(index.seen) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(index.grams, h[at]), len(index.grams) - 1)
        hit = index.grams[k] == h[at]
        at, k = at[hit], k[hit]
        rows = np.searchsorted(offsets, at, side="right") - 1
        inside = at + Q <= offsets[rows + 1]
        at, k, rows = at[inside], k[inside], rows[inside]
        best: dict = {}
        reach = np.cumsum(index.begin[k + 1] - index.begin[k])
        start = 0
        while start < len(k):  # about PIECE postings, and those of regions that begin among them
            stop = max(start + 1, int(np.searchsorted(reach, (reach[start - 1] if start else 0) + PIECE, side="right")))
            end = int(np.searchsorted(at, at[stop - 1] + REACH, side="right"))
            _verify(index, data, offsets, *_regions(index, h, offsets, at[start:end], k[start:end], rows[start:end]), best)
            start = stop
        found += [(r, i, len(v[0]), v[1], v[2]) for (r, i), v in sorted(best.items())]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.array(c, dtype=np.int64) for c in zip(*found))


def _short_items(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """Matches of items that are their own q-gram: whole, between word borders; the first of a text."""
    gap = np.ones(len(data) + 1, dtype=bool)  # borders before each byte, and at the end
    gap[1:-1] = data[:-1] == 0x20
    gap[offsets] = True
    stop = np.ones(len(data) + 1, dtype=bool)
    stop[:-1] = data == 0x20
    stop[offsets] = True
    starts = np.flatnonzero(gap[:-1] & (data != 0x20))
    ends = offsets[np.searchsorted(offsets, starts, side="right")]
    spans = []
    for size in index.short_sizes:
        good = starts + size <= ends
        good[good] = stop[starts[good] + size]
        spans.append(np.stack([starts[good], starts[good] + size]))
    a, b = np.concatenate(spans, axis=1)
    h = textkit.span_hashes(data, a, b)
    low, high = np.searchsorted(index.short, h), np.searchsorted(index.short, h, side="right")
    best: dict = {}
    for i in np.flatnonzero(low < high):
        row = int(np.searchsorted(offsets, a[i], side="right")) - 1
        text = data[a[i] : b[i]].tobytes()
        for j in range(low[i], high[i]):
            if index.texts[j] == text:
                key, end = (row, int(index.short_item[j])), int(b[i] - offsets[row])
                best[key] = min(best.get(key, end), end)
    return [(row, item, 1, 0, end) for (row, item), end in sorted(best.items())]


def _regions(index: Index, h: np.ndarray, offsets: np.ndarray, at: np.ndarray, k: np.ndarray, rows: np.ndarray):
    """(row, window, band) where enough different q-grams of the window meet in a band of diagonals."""
    count = index.begin[k + 1] - index.begin[k]
    rep = np.repeat(np.arange(len(k)), count)
    post = textkit.spread(index.begin[k], count)
    band = (at[rep] - index.place[post]) // HALF_BAND
    # A diagonal lies in two bands; each q-gram of a window counts once in a band.
    bands, windows = len(h) // HALF_BAND + 64, len(index.length)
    key, place = (rows[rep] * windows + index.window[post]) * bands + band + 32, index.place[post]
    key, place = np.concatenate([key, key - 1]), np.concatenate([place, place])
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    key, count = np.unique(key[new], return_counts=True)
    band, row = key % bands - 32, key // bands
    row, window = row // windows, row % windows
    good = count >= index.need[window]
    row, window, band = row[good], window[good], band[good]
    enough = index.whole[window].copy()
    part = np.flatnonzero(~enough)
    for s in range(0, len(part), 4096):
        i = part[s : s + 4096]
        enough[i] = _shared(index, h, offsets, row[i], window[i], band[i]) >= _bound(index.length[window[i]])
    return row[enough], window[enough], band[enough]


def _bound(size: np.ndarray) -> np.ndarray:
    return size - Q + 1 - Q * edits_allowed(size)


def _shared(index: Index, h: np.ndarray, offsets: np.ndarray, row: np.ndarray, window: np.ndarray, band: np.ndarray) -> np.ndarray:
    """How many of each window's q-grams stand in its row on a diagonal of its band."""
    wide = index.patterns.shape[1] - Q + 1
    letters = textkit._LETTERS[index.patterns[window]]
    own = np.zeros((len(window), wide), dtype=np.uint64)
    for j in range(Q):
        own = own * textkit.NGRAM_STEP + letters[:, j : j + wide]
    own = textkit.mix(own)
    low, high = offsets[row][:, None], offsets[row + 1][:, None] - Q
    met = np.zeros(own.shape, dtype=bool)
    first = band[:, None] * HALF_BAND + np.arange(wide)
    for shift in range(2 * HALF_BAND):
        place = first + shift
        met |= (place >= low) & (place <= high) & (h[np.clip(place, 0, len(h) - 1)] == own)
    met &= np.arange(wide) <= index.length[window][:, None] - Q
    return met.sum(axis=1)


def _verify(index: Index, data, offsets, row, window, band, best: dict) -> None:
    """Align the regions; best: (row, item) -> [windows, least edits, end of that region]."""
    most = int(edits_allowed(np.array([WINDOW + WINDOW // 2]))[0])
    spread = 2 * HALF_BAND + 2 * most + 1
    for s in range(0, len(row), 4096):
        r, w, b = row[s : s + 4096], window[s : s + 4096], band[s : s + 4096]
        edits, end = banded_edits(data, offsets[r], offsets[r + 1], b * HALF_BAND - most, index.patterns[w], index.length[w], spread)
        for i in np.flatnonzero(edits <= edits_allowed(index.length[w])):
            this = (int(edits[i]), int(end[i] - offsets[r[i]]))
            for item in index.owner[index.owners[w[i]] : index.owners[w[i] + 1]].tolist():
                old = best.setdefault((int(r[i]), item), [set(), 1 << 20, 0])
                old[0].add(int(w[i]))
                if this < (old[1], old[2]):
                    old[1:] = this


def index_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Indexes of benchmark(item_id, text), each over about block_bytes of text."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col("text"))), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    for b in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        items = part.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toArrow()  # about block_bytes
        if items.num_rows:
            yield build_index(items.column(0).combine_chunks(), items.column(1).combine_chunks())


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, edits, end_byte: one row for each document and item it holds.

    n_windows: matched windows of the item; edits: the least of them; end_byte: where that region
    ends in the normalised text.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, n_windows long, edits long, end_byte long"
    out = None
    for index in index_blocks(benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in textkit.chunks(batches, "text", 1 << 20):
                row, item, windows, edits, end = search(held.value, batch.column(1))
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), held.value.item_ids.take(pa.array(item)), pa.array(windows), pa.array(edits), pa.array(end)], names=["doc_id", "item_id", "n_windows", "edits", "end_byte"])

        part = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    at = docs.columns.index("text")
    for index in index_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in textkit.chunks(batches, "text", 1 << 20):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[search(held.value, batch.column(at))[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
