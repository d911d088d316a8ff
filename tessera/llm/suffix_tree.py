"""LM scoring with a probabilistic suffix tree over words.

A text's tokens are its lower-cased (A-Z) words, then one end. A context is what stands before a token:
up to DEPTH tokens of the same text, where the end also stands for the text's beginning.
1. The root's distribution is the add-one unigram model of the contract: (c + 1) / (N + V + 1), where V
   known tokens and one unknown token share the probability.
2. A longer context is considered if its suffix is retained and it occurs MIN_COUNT times, a number that
   does not depend on the corpus, so the tree grows with it. It is retained if its next tokens diverge
   from the distribution of its suffix: if each of them is likelier after the context, as the others
   make its distribution, than after the suffix, by their summed log ratio. (A plain likelihood ratio
   retains every rare context, as what it is tested on is what it was made of.)
3. A retained context's distribution is smoothed towards its suffix's: (c + w p) / (n + w), where n
   tokens of k kinds follow it and w = PRIOR k. So every distribution sums to one. A context that is not
   retained has its suffix's distribution; a token is scored from the longest suffix state of what
   precedes it. `score` is the sum of these log10 probabilities.

Counting is exact, however the rows are partitioned. The texts are read once: each task packs chunks of
its rows into batches (token numbers and the batch's words), which are files on shared storage and are
never shuffled. The words' hashes go once counted; answers are shuffled once, then kept in a batch's files. Then, for each length of context, batches ask for their distinct (context, next token)
pairs with their training counts, dealt to shards by context; a shard adds the counts up, tests its
contexts and answers each batch in the order it asked. Pairs are thus combined before they are shuffled, and
a batch learns only what its own texts need. A context of over SHARD_TOKENS occurrences is shared by several
shards; they say how many of its pairs have which count and log probability, which is all that the test
reads, and these tables are added up and tested by a job of their own. Nothing but sums (two numbers a
shard; a row for each shared context) comes to the driver. Only contexts whose suffixes occur often are
asked for.

Words are compared by 64-bit hashes. The shards of words number them, by falling count within a shard, and
contexts of one or two words and the tokens after them are compared by these numbers, so none is mistaken
for another (longer contexts: by 64-bit hashes). Frequent words have small numbers, which pack well. All
unknown words share a number. The test uses the suffix's log probabilities in steps of 1 / LOG_STEPS and adds log ratios in steps
of 1 / RATIO_STEPS, so that their sum doesn't depend on their order or on the shards.

Edge cases: null texts are empty (the end token alone); rows without doc_id are learnt from; repeated
rows are learnt from and scored each; without training texts every token is unknown, with probability 1;
a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared, textkit
from tessera.llm.token_files import _local, _read, _write

FOLDS, HELD_OUT = 7, 2
#: Tokens of the longest context.
DEPTH = 2
#: Times that a context must occur.
MIN_COUNT = 4
#: Weight of the suffix's distribution, in counts, for each different token seen after a context.
PRIOR = 2.0
#: Bytes of text in a batch, about.
BATCH_BYTES = 10 << 20
#: Tokens for each shard, about.
SHARD_TOKENS = 2_000_000
#: Steps of a natural logarithm in what batches tell the test.
LOG_STEPS = 8
#: Steps of a natural logarithm in the test's sums.
RATIO_STEPS = 1 << 20
END = np.uint64(1)
_STEP = np.uint64(0x9FB21C651E98DF25)


# --- packed arrays ----------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte by byte of all, compressed."""
    head, raw = bytearray([len(arrays)]), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little")
        raw.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    body = b"".join(raw)
    return bytes(head) + len(body).to_bytes(8, "little") + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpack(data: bytes) -> list[np.ndarray]:
    count, at, kinds = data[0], 1, []
    for _ in range(count):
        kinds.append((np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")))
        at += 12
    size = int.from_bytes(data[at : at + 8], "little")
    body = np.frombuffer(pa.decompress(data[at + 8 :], size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        stop = at + n * kind.itemsize
        out.append(np.ascontiguousarray(body[at:stop].reshape(kind.itemsize, n).T).view(kind).reshape(-1))
        at = stop
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, which pack well."""
    return np.diff(a, prepend=a.dtype.type(0))


def unsteps(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def _firsts(groups: np.ndarray) -> np.ndarray:
    """The first place of each group of neighbours."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(groups)), bool), groups[1:] != groups[:-1]]))


def gaps(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of 32-bit numbers that ascend within groups, anew from each group's first place."""
    out = steps(a)
    out[first] = a[first]
    return out


def ungaps(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    reach = unsteps(a)
    before = np.where(first > 0, reach[first - 1], 0).astype(a.dtype)
    return reach - np.repeat(before, np.diff(np.append(first, len(a))))


# --- batches ----------------------------------------------------------------------------------------


def _words(folder: str) -> str:
    return folder + "-words"


def _packing(folder: str, batch_bytes: int):
    """Writes the batches of (doc_id, held, text), their words' hashes apart; one row with the number of tokens
    for each. Names are random, and only those that a finished task lists are read."""

    def run(rows):
        held, size = [], 0

        def flush():
            ids = pa.concat_arrays([h[0] for h in held])
            out, counts = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            kinds, tokens, often = np.unique(out, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable").astype(np.uint32)  # small numbers for frequent words
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            data = pack(np.asarray(ids.fill_null(0)), np.array(ids.is_null()), np.concatenate([h[1] for h in held]), counts.astype(np.uint32), np.flatnonzero(kinds == END), order, rank[tokens])
            batch = uuid.uuid4().int >> 66
            _write(f"{folder}/{batch}", [np.frombuffer(data, np.uint8)])
            _write(f"{_words(folder)}/{batch}", [np.frombuffer(pack(steps(kinds)), np.uint8)])
            return pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([len(out)])], names=["batch", "tokens"])

        for rows_ in textkit.chunks(rows, "text"):
            words = textkit.Words(rows_.column(2), lower=True)
            held.append((rows_.column(0), np.array(rows_.column(1)), np.insert(words.hashes(), words.first[1:], END), np.diff(words.first) + 1))
            size += len(words.data)
            if size >= batch_bytes:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


class Batch:
    """Unpacked: the rows and their tokens, and what the answers so far say about each token."""

    def __init__(self, uri: str, shards: int, shard_tokens: int):
        self.shards, self.shard_tokens = shards, shard_tokens
        self.ids, self.missing, self.held, self.sizes, self.end, order, tokens = unpack(_read(uri))
        self.kinds, self.tokens = len(order), order[tokens]
        first = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.first, self.place = first, np.arange(len(self.tokens)) - np.repeat(first, self.sizes)
        self.taught = np.repeat(~self.held.astype(bool), self.sizes)

    def ask_words(self, uri: str):
        """(shard, block) of the words, whose hashes are in that file, and their training counts."""
        kinds = unsteps(unpack(_read(uri))[0])
        n = np.bincount(self.tokens, weights=self.taught, minlength=self.kinds).astype(np.uint32)
        for s, at in _split(_shard(kinds, self.shards)):
            yield s, pack(steps(kinds[at]), n[at])

    def hear_words(self, answers: dict[int, bytes], n: int, v: int) -> None:
        used = sorted(answers)  # both words and shards are in the order of hashes
        each = [unpack(answers[s]) for s in used]
        c, rank = (np.concatenate(x) for x in zip(*each))
        number = (rank.astype(np.int64) + 1) * self.shards + np.repeat(used, [len(x) for x, _ in each])
        number[c == 0] = 0  # all unknown words
        if number.max() >> 32:
            raise ValueError("more different words than 32 bits can number")
        self.count = c[self.tokens]
        self.known = self.count > 0
        self.base = self.probability = (self.count + 1.0) / (n + v + 1.0)
        self.total = self._before(self.count, int(c[self.end[0]]))  # of the contexts of one token
        self.symbol = number.astype(np.uint32)[self.tokens]
        self.context = np.zeros(len(self.tokens), np.uint64)
        self.state = np.ones(len(self.tokens), bool)  # whether what precedes a token ends in a state of the last length
        self.word_before, self.before_all = self.symbol, np.uint32(number[self.end[0]])

    def _before(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before each, `start` for the first of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def _pairs(self, depth: int):
        """Ask and answer agree on this: (alive tokens, the pair of each, contexts, their totals, first
        pair of each context, symbol of each pair, blocks), for the contexts of `depth` tokens."""
        if depth > 1:  # how often a longer context occurs is what the last answer said one token before
            self.total = np.where(self.place >= depth - 1, self._before(self.count, 0), 0)
        self.word_before = self._before(self.word_before, self.before_all)
        self.context = self.context << np.uint64(32) | self.word_before if depth < 3 else textkit.mix(self.context * _STEP + self.word_before)
        alive = np.flatnonzero((self.total >= MIN_COUNT) & self.state)
        contexts, one, back = np.unique(self.context[alive], return_index=True, return_inverse=True)
        totals = self.total[alive][one]
        pairs, pair = np.unique(back.astype(np.uint64) << np.uint64(32) | self.symbol[alive], return_inverse=True)
        symbols, owner = pairs.astype(np.uint32), (pairs >> np.uint64(32)).astype(np.int64)
        salts = -(-totals // self.shard_tokens).astype(np.uint64)
        salt = textkit.mix(symbols.astype(np.uint64)) % salts[owner]
        return alive, pair, contexts, totals, owner, symbols, _shard(textkit.mix(contexts)[owner] + salt * _STEP, self.shards)

    def ask(self, depth: int):
        """(shard, block) of the pairs of contexts of `depth` tokens and their next tokens."""
        alive, pair, contexts, totals, owner, symbols, shard = self._pairs(depth)
        n = np.bincount(pair, weights=self.taught[alive], minlength=len(symbols)).astype(np.uint32)
        log = np.zeros(len(symbols), np.uint8)
        log[pair] = np.minimum(255, np.rint(-np.log(self.probability[alive]) * LOG_STEPS)).astype(np.uint8)
        if depth > 1:
            log[n == 0] = 0
        for s, at in _split(shard):
            own, symbol, told = owner[at], symbols[at], log[at]
            first = _firsts(own)
            mine = contexts[own[first]]
            high, low = (mine >> np.uint64(32)).astype(np.uint32), mine.astype(np.uint32)
            if depth == 1:  # what the unigram says depends on the word alone and falls with its number, nearly
                told = steps(told[np.unique(symbol, return_index=True)[1]])
            yield s, pack(steps(high), gaps(low, _firsts(high)), totals[own[first]] > self.shard_tokens, np.diff(np.append(first, len(own))).astype(np.uint32), gaps(symbol, first), n[at], told)

    def hear(self, depth: int, answers: dict[int, bytes], hot: tuple, always: float) -> None:
        alive, pair, contexts, totals, owner, symbols, shard = self._pairs(depth)
        count, kinds, keep = np.zeros(len(symbols), np.int64), np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
        for s, at in _split(shard):
            own = owner[at]
            c, k, kept = unpack(answers[s])
            mine = own[np.concatenate([[True], own[1:] != own[:-1]])]
            count[at], kinds[mine], keep[mine] = c, k, kept
        parted = np.flatnonzero(totals > self.shard_tokens)
        at = np.searchsorted(hot[0], contexts[parted])
        kinds[parted], keep[parted] = hot[1][at], hot[2][at] | (totals[parted] > always)
        self.count = np.zeros(len(self.tokens), np.int64)
        self.count[alive] = count[pair]
        good = keep[owner][pair]
        at, pair = alive[good], pair[good]
        self.state = np.zeros(len(self.tokens), bool)
        self.state[at] = True
        weight = PRIOR * kinds[owner[pair]]
        self.probability = self.probability.copy()
        self.probability[at] = (count[pair] + weight * self.probability[at]) / (totals[owner[pair]] + weight)

    def scores(self, n_taught: int) -> pa.Table:
        sums = lambda x: np.add.reduceat(x, self.first)
        n = len(self.ids)
        return pa.table({
            "doc_id": pa.array(self.ids, mask=self.missing), "held_out": self.held.astype(bool), "n_tokens": self.sizes.astype(np.int64), "n_known": sums(self.known.astype(np.int64)),
            "train_tokens": np.full(n, n_taught, dtype=np.int64), "base_score": sums(np.log10(self.base)), "score": sums(np.log10(self.probability)),
        })


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a 64-bit hash: shards are ranges, so the words that a batch asks of one lie close."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _split(shard: np.ndarray):
    """(shard, places) for each shard in use; places ascend."""
    order = np.argsort(shard, kind="stable")
    used, first = np.unique(shard[order], return_index=True)
    for s, a, b in zip(used.tolist(), first, np.append(first[1:], len(order))):
        yield s, order[a:b]


# --- shards -----------------------------------------------------------------------------------------


def answer_words(blocks: list[bytes]) -> tuple[list[bytes], bytes]:
    """(counts and ranks by count of all batches' words, block by block; number of words and of tokens)."""
    parts = [unpack(b) for b in blocks]
    kinds, back = np.unique(np.concatenate([unsteps(k) for k, _ in parts]), return_inverse=True)
    c = np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(kinds)).astype(np.int64)
    rank = np.empty(len(kinds), np.uint32)
    rank[np.argsort(-c, kind="stable")] = np.arange(len(kinds), dtype=np.uint32)
    rank[c == 0] = 0
    cuts = np.cumsum([len(k) for k, _ in parts])[:-1]
    return [pack(*e) for e in zip(np.split(c[back], cuts), np.split(rank[back], cuts))], pack(np.array([np.count_nonzero(c), c.sum()]))


def divergence(c: np.ndarray, total: np.ndarray, kinds: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log ratio of the c places of each next token, in steps: its probability after the context, as the
    context's other places make it, to p, that after the suffix."""
    once, others = PRIOR * (kinds - 1), total - 1
    with np.errstate(divide="ignore"):
        new = np.log(once / np.maximum(others + once, 1))  # no other place has the token
    weight = PRIOR * kinds
    return np.rint(c * np.where(c == 1, new, np.log((c - 1 + weight * p) / ((others + weight) * p))) * RATIO_STEPS)


def _asked(block: bytes, depth: int) -> tuple:
    """(contexts, whether others have parts of them, the number of their pairs; symbols, counts and logs of
    the pairs) of a block."""
    high, low, parted, long, symbols, n, log = unpack(block)
    high, long = unsteps(high), long.astype(np.int64)
    symbols = ungaps(symbols, np.cumsum(long) - long)
    if depth == 1:
        log = unsteps(log)[np.unique(symbols, return_inverse=True)[1]]
    return high.astype(np.uint64) << np.uint64(32) | ungaps(low, _firsts(high)), parted, long, symbols, n, log


def answer_pairs(blocks: list[bytes], depth: int, last: bool) -> tuple[list[bytes], bytes]:
    """(counts of the pairs, kinds and retention of the contexts, block by block; context, count, log and
    number of the pairs of contexts that other shards have parts of).

    last: no longer contexts follow, so counts matter only after retained contexts."""
    parts = [_asked(b, depth) for b in blocks]
    sizes = [len(p[0]) for p in parts]
    contexts, one, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    parted = np.concatenate([p[1] for p in parts])[one]
    long = np.concatenate([p[2] for p in parts])
    symbols = np.concatenate([p[3] for p in parts])
    key = np.repeat(back, long).astype(np.uint64) << np.uint64(32) | symbols
    pairs, pair = np.unique(key, return_inverse=True)
    c = np.bincount(pair, weights=np.concatenate([p[4] for p in parts]), minlength=len(pairs))
    log = np.zeros(len(pairs), np.uint8)
    np.maximum.at(log, pair, np.concatenate([p[5] for p in parts]))
    owner = (pairs >> np.uint64(32)).astype(np.int64)
    seen = c > 0
    kinds = np.bincount(owner[seen], minlength=len(contexts))
    total = np.bincount(owner, weights=c, minlength=len(contexts))
    own = owner[seen]
    keep = np.bincount(own, weights=divergence(c[seen], total[own], kinds[own], np.exp(-(log[seen] / LOG_STEPS))), minlength=len(contexts)) > 0
    if last:
        c[~(keep | parted)[owner]] = 0
    counts = c.astype(np.uint32)[pair]
    out, at_context, at_pair = [], 0, 0
    for p, size in zip(parts, sizes):
        mine = back[at_context : at_context + size]
        out.append(pack(counts[at_pair : at_pair + len(p[3])], kinds[mine].astype(np.uint32), keep[mine]))
        at_context, at_pair = at_context + size, at_pair + len(p[3])
    shared = np.flatnonzero(parted[owner])
    table, number = np.unique(np.stack([owner[shared], c[shared].astype(np.int64), log[shared].astype(np.int64)]), axis=1, return_counts=True)
    return out, pack(contexts[table[0]], table[1], table[2], number)


# --- rounds -----------------------------------------------------------------------------------------

_BLOCK = "batch long, shard int, level int, data binary"
#: In place of a shard: the names of a batch's files.
_FILES = -1


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [("batch", pa.int64()), ("shard", pa.int32()), ("level", pa.int32()), ("data", pa.binary())]
    return pa.table([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], schema=pa.schema(kinds))


def _parts(batches):
    """Rows of the tables of the contexts that several shards share."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            context, *numbers = unpack(data)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (context.view(np.int64), *numbers)], names=["context", "c", "log", "n"])


def _test(key, table):
    """Kinds and retention of a context from its parts' tables."""
    c, log, n = (table.column(x).to_numpy() for x in ("c", "log", "n"))
    seen = c > 0
    c, log, n = c[seen], log[seen], n[seen]
    kinds = n.sum()
    gain = (n * divergence(c, (n * c).sum(), kinds, np.exp(-(log / LOG_STEPS)))).sum()
    return pa.table({"context": [key[0].as_py()], "kinds": [int(kinds)], "keep": [bool(gain > 0)]})


def _whole(sums: DataFrame) -> tuple:
    """(contexts, kinds, retention) of the contexts that several shards share."""
    rows = sums.select("data").mapInArrow(_parts, "context long, c long, log long, n long")
    found = rows.groupBy("context", "c", "log").agg(F.sum("n").alias("n")).groupBy("context").applyInArrow(_test, "context long, kinds long, keep boolean").collect()
    contexts = np.array([r["context"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(contexts)
    return contexts[order], np.array([r["kinds"] for r in found], np.int64)[order], np.array([r["keep"] for r in found], bool)[order]


@dataclass
class _Told:
    """What every batch knows: where batches are, the number of shards, the occurrences from which a context
    isn't tested, the number of tokens and of different words, and the contexts that several shards share,
    by their length."""

    folder: str
    shards: int
    shard_tokens: int
    always: float
    n: int = 0
    v: int = 0
    hots: list = field(default_factory=list)

    def batch(self, key, answers: pa.Table | None, levels: int) -> tuple[Batch, list[str], dict[int, bytes]]:
        """A batch that has heard the answers of so many levels, the files that hold the earlier ones, and
        the last one's answers."""
        batch = Batch(f"{self.folder}/{key[0].as_py()}", self.shards, self.shard_tokens)
        last = dict(zip(*(answers.column(c).to_pylist() for c in ("shard", "data")))) if levels else {}
        files = last.pop(_FILES, b"").decode().split()
        for d, given in enumerate([*map(_load, files), last][:levels]):
            if d:
                batch.hear(d, given, self.hots[d - 1], self.always)
            else:
                batch.hear_words(given, self.n, self.v)
        return batch, files, last


def _save(uri: str, answers: dict[int, bytes]) -> None:
    sizes = np.array([[s, len(d)] for s, d in answers.items()], np.int64).reshape(-1, 2)
    _write(uri, [np.array([len(sizes)], np.int64), sizes.reshape(-1), np.frombuffer(b"".join(answers.values()), np.uint8)])


def _load(uri: str) -> dict[int, bytes]:
    data = _read(uri)
    sizes = np.frombuffer(data, np.int64, 2 * int(np.frombuffer(data, np.int64, 1)[0]), 8).reshape(-1, 2)
    stops = 8 + 8 * sizes.size + np.cumsum(sizes[:, 1])
    return {int(s): bytes(data[b - n : b]) for (s, n), b in zip(sizes.tolist(), stops.tolist())}


def _asking(told: _Told, level: int):
    """Asks; what a batch was answered last goes to a file of its own, so that answers are shuffled once. The
    names of a batch's files take the way of a block."""

    def ask(key, answers):
        name = key[0].as_py()
        batch, files, last = told.batch(key, answers, level)
        if not level:
            return _table([(name, s, level, d) for s, d in batch.ask_words(f"{_words(told.folder)}/{name}")])
        files.append(f"{told.folder}/{name}-{uuid.uuid4().hex}")
        _save(files[-1], last)
        return _table([*((name, s, level, d) for s, d in batch.ask(level)), (name, _FILES, level, "\n".join(files).encode())])

    return ask


def _answering(level: int, last: bool):
    def answer(key, table):
        shard, blocks = key[0].as_py(), table.column("data").to_pylist()
        if shard == _FILES:
            return table
        each, sums = answer_pairs(blocks, level, last) if level else answer_words(blocks)
        return _table([*((b, shard, level, d) for b, d in zip(table.column("batch").to_pylist(), each)), (-1, shard, level, sums)])

    return answer


def _finishing(told: _Told, levels: int):
    return lambda key, answers: told.batch(key, answers, levels)[0].scores(told.n)


def score_documents(docs: DataFrame, held_out: Column | None = None, depth: int = DEPTH, shard_tokens: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of
    docs(doc_id, text); rows that are not held out are learnt from.

    shard_tokens: SHARD_TOKENS if not given, and then all contexts are tested; if given, contexts of more
    occurrences are retained without the test."""
    spark = docs.sparkSession
    always = math.inf if shard_tokens is None else shard_tokens
    shard_tokens = shard_tokens or SHARD_TOKENS
    if held_out is None:
        held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    folder = shared.new_path(spark, "suffix-batches")
    for place in (folder, _words(folder)):
        if _local(place):
            os.makedirs(_local(place), exist_ok=True)
    listed = shared.materialise(rows.mapInArrow(_packing(folder, batch_bytes), "batch long, tokens long"), "suffix-listed")
    size = listed.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    told = _Told(folder, max(1, -(-size["tokens"] // shard_tokens)), shard_tokens, always)
    answers, spent = listed.select("batch"), _words(folder)

    def by_batch(rows: DataFrame):  # a task for each batch, about
        return rows.repartition(max(size["batches"], 1), "batch").groupBy("batch")

    for level in range(depth + 1):
        asked = by_batch(answers).applyInArrow(_asking(told, level), _BLOCK)
        found, path = shared.store(asked.groupBy("shard").applyInArrow(_answering(level, level == depth), _BLOCK), "suffix-answers")
        shared.drop(spark, spent)
        spent = path
        sums = found.where("batch < 0")
        if level:
            told.hots.append(_whole(sums))
        else:  # a row for each shard
            told.v, told.n = (int(x) for x in np.sum([unpack(bytes(r["data"]))[0] for r in sums.select("data").collect()] or [[0, 0]], axis=0))
        answers = found.where("batch >= 0")
        shared.release(spark)  # of this level: the last job's shuffles are held until another one has run
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = shared.materialise(by_batch(answers).applyInArrow(_finishing(told, depth + 1), schema), "suffix-scores")
    for path in (spent, folder):
        shared.drop(spark, path)
    return out
