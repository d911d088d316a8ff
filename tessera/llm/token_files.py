"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

A part is three files: ``<part>.bin`` (ids, little-endian, 16 or 32 bits), ``<part>.idx`` (int64: the
first id of each document inside the part, then the total) and ``<part>.doc`` (int64 document ids).
Parts are in ascending doc_id order; the base of a part is the prefix sum of the totals before it.

Edge cases: null text is empty, an empty document is one end id; rows that share a doc_id stay
neighbours in the order of their text's hash; null doc_ids come first; no rows give no parts.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared, textkit

END_ID = 0
#: Bytes of text in a part at most, about, where the number of shuffle partitions is not enough.
PART_BYTES = 256 << 20
_NULL_ID = np.iinfo(np.int64).min
#: Pieces that a process keeps, at about 40 bytes each.
_KEPT = 2_000_000


class Encoder:
    """Whole-text ids, by the tokenizers library.

    A byte-level BPE with the usual word pattern never joins tokens across these places, where texts
    are cut into pieces: before a single space between two non-space characters, after a single line
    feed between two such, and before one of ``,.;:!?)`` that follows an ASCII letter or digit. Every
    distinct piece is encoded once, many in one call (the lengths of the tokens tell where a piece
    ends), and its ids are kept under its 64-bit hash. Texts with other white space than ASCII's, and
    all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(True)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
            and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or not a["content"].isascii() or set(a["content"]) & set(" \n,.;:!?)") for a in added)
        )
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.vocabulary)], dtype=np.int64)
        self._clear()

    def _clear(self):
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        data, offsets = textkit.string_buffers(texts)
        whole = np.ones(len(texts), dtype=bool)
        if self.by_piece:
            whole = np.zeros(len(texts), dtype=bool)
            whole[np.searchsorted(offsets, _odd_spaces(data), side="right") - 1] = True
        starts = _cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        rows = np.searchsorted(offsets, starts, side="right") - 1
        mine = ~whole[rows]
        starts, ends, rows = starts[mine], ends[mine], rows[mine]
        h = textkit.span_hashes(data, starts, ends)
        kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > _KEPT:
            self._clear()
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, kinds), len(self.hashes) - 1)
            new = np.flatnonzero(self.hashes[at] != kinds)
        else:
            new = np.arange(len(kinds))
        if len(new):
            self._learn(data, kinds[new], starts[first[new]], ends[first[new]])
        at = np.searchsorted(self.hashes, kinds)[which]
        long = self.size[at]
        ids = self.ids[textkit.spread(self.begin[at], long)]
        counts = np.bincount(rows, weights=long, minlength=len(texts)).astype(np.int64)
        size = np.bincount(np.repeat(rows, long), weights=self.token_bytes[ids], minlength=len(texts))
        whole |= size != np.diff(offsets)
        if not whole.any():
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(whole):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def _learn(self, data, kinds, starts, ends) -> None:
        gap, last = textkit.SPACE[data[starts]], textkit.SPACE[data[ends - 1]]
        size = ends - starts
        second = textkit.SPACE[data[np.minimum(starts + 1, len(data) - 1)]] | (size < 2)
        spaced = (data[starts] == 0x20) & ~second & ~last  # one space, then none at either end
        plain = ~gap & ~last
        got = [np.zeros(0, np.uint32)] * len(kinds)
        for group, glue in ((np.flatnonzero(spaced), b""), (np.flatnonzero(plain), b"\n")):
            for s in range(0, len(group), 8192):
                part = group[s : s + 8192]
                text = glue.join(data[a:b].tobytes() for a, b in zip(starts[part], ends[part]))
                ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
                stop = np.cumsum(self.token_bytes[ids])
                to = np.cumsum(size[part] + len(glue)) - len(glue)
                b = np.searchsorted(stop, to) + 1
                a = np.searchsorted(stop, to - size[part], side="right") if glue else np.append(0, b[:-1])
                for k, i, j in zip(part, a, b):
                    got[k] = ids[i:j]
        for k in np.flatnonzero(~spaced & ~plain):
            got[k] = np.array(self.tokenizer.encode(data[starts[k] : ends[k]].tobytes().decode(), add_special_tokens=False).ids, dtype=np.uint32)
        long = np.array([len(x) for x in got], dtype=np.int64)
        begin = len(self.ids) + np.cumsum(long) - long
        order = np.argsort(hashes := np.concatenate([self.hashes, kinds]), kind="stable")
        self.hashes = hashes[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.size = np.concatenate([self.size, long])[order]
        self.ids = np.concatenate([self.ids, *got])


_ALNUM = np.array([c < 0x80 and chr(c).isalnum() for c in range(256)])
_STOPS = np.isin(np.arange(256), list(b",.;:!?)"))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts start; see Encoder."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    gap = textkit.SPACE[data]
    if n > 2:
        inner = ~edge[1 : n - 1] & ~edge[2:n]  # the byte before and the one after are of the same text
        cut[1 : n - 1] = (data[1:-1] == 0x20) & ~gap[:-2] & ~gap[2:] & inner
        cut[2:n] |= (data[1:-1] == 0x0A) & ~gap[:-2] & ~gap[2:] & inner
    if n > 1:
        cut[1:n] |= _STOPS[data[1:]] & _ALNUM[data[:-1]]
    return np.flatnonzero((cut | edge)[:n])


def _odd_spaces(data: np.ndarray) -> np.ndarray:
    """Positions of white space outside ASCII, and of the control characters some call space."""
    lead = np.flatnonzero(((data >= 0x1C) & (data <= 0x1F)) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if not len(lead):
        return lead
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    odd = (a < 0x20) | (a == 0xC2) & ((b == 0xA0) | (b == 0x85)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return lead[odd]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this process; what it has learnt serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(uri: str):
    """(filesystem, path) of a URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _local(uri: str) -> str | None:
    """The path of a URI of a mounted folder."""
    at = urlparse(uri)
    return at.path if at.scheme in ("", "file") else None


def _write(uri: str, parts: list) -> None:
    system, path = _filesystem(uri)
    with system.open_output_stream(path) as out:
        for p in parts:
            out.write(np.ascontiguousarray(p).view(np.uint8).data if len(p) else b"")


def _read(uri: str):
    """The file's bytes: memory-mapped where the folder is mounted, else read."""
    if path := _local(uri):
        if not os.path.getsize(path):
            return b""
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    system, path = _filesystem(uri)
    with system.open_input_file(path) as f:
        return f.read()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None) -> list[dict]:
    """Write the files of all rows of (doc_id, text) under `path`; returns one entry for each part.

    An entry has part, file, n_docs, n_tokens, width (bytes of an id) and base (ids before the part).
    File names carry the task attempt, and only what a finished task returned is listed, so a task
    that is run again leaves no wrong data. The entries, one for each partition, come to the driver,
    which adds the prefix sums and writes them as ``index.json``.
    """
    spark = docs.sparkSession
    if _local(path):
        os.makedirs(_local(path), exist_ok=True)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        stem = f"{path}/part-{part:06d}-{uuid.uuid4().hex}"
        encoder, width, n_docs, n_ids = None, 4, 0, 0
        streams = {}

        def put(kind, array):
            if kind not in streams:
                system, p = _filesystem(f"{stem}.{kind}")
                streams[kind] = system.open_output_stream(p)
            streams[kind].write(np.ascontiguousarray(array).tobytes())

        for rows in textkit.chunks(batches, "text"):
            if encoder is None:
                encoder = encoder_of(tokenizer_path)
                width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
            ids, counts = encoder.encode(rows.column(1))
            ends = np.cumsum(counts)
            put("bin", np.insert(ids, ends, end_id).astype(f"<u{width}"))
            put("idx", (n_ids + ends - counts + np.arange(len(counts))).astype("<i8"))
            put("doc", np.array([_NULL_ID if i is None else i for i in rows.column(0).to_pylist()], dtype="<i8"))
            n_docs, n_ids = n_docs + len(counts), n_ids + int(ends[-1]) + len(counts)
        if n_docs:
            put("idx", np.array([n_ids], dtype="<i8"))
            for s in streams.values():
                s.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": stem, "n_docs": n_docs, "n_tokens": n_ids, "width": width}])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if partitions is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PART_BYTES), 1)
    order = (F.col("doc_id"), F.xxhash64("text"))
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions, *order, "row")  # equal rows may part
    ordered = dealt.sortWithinPartitions(*order, "text").drop("row")
    entries = [r.asDict() for r in ordered.mapInArrow(run, "part long, file string, n_docs long, n_tokens long, width long").collect()]
    entries.sort(key=lambda e: e["part"])
    base = 0
    for e in entries:
        e["base"] = base
        base += e["n_tokens"]
    _write(f"{path}/index.json", [np.frombuffer(json.dumps({"end_id": end_id, "parts": entries}).encode(), np.uint8)])
    return entries


def read_tokens(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    start counts the ids of all documents before it; the crc is over the ids as unsigned 32 bits.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not entries:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for e in batch.to_pylist():
                ids = np.frombuffer(_read(e["file"] + ".bin"), dtype=f"<u{e['width']}")
                idx = np.frombuffer(_read(e["file"] + ".idx"), dtype="<i8")
                doc = np.frombuffer(_read(e["file"] + ".doc"), dtype="<i8")
                for at in range(0, len(doc), 8192):
                    a, b = idx[at : at + 8192], idx[at + 1 : at + 8193]
                    a = a[: len(b)]
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(a, b)]
                    own = doc[at : at + len(a)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == _NULL_ID), pa.array(a + e["base"]), pa.array(b - a), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(e["file"], e["width"], e["base"]) for e in entries], "file string, width long, base long")
    return listed.repartition(len(entries)).mapInArrow(run, schema)


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the token files of all documents to shared storage and read them back."""
    spark = docs.sparkSession
    path = shared.new_path(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, path, tokenizer_path, end_id))
