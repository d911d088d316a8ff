"""Chat formatting with typed content parts.

A visitor flattens text, image, audio and document parts into one string with ordered placeholders and
records attachment references and how many tokens each placeholder stands for. Attachments are numbered
through their conversation. Turns are marked by control strings; inside texts and roles they are escaped,
and `read_turn` undoes it.

Edge cases: null role, text or parts are empty; a part of no type is text, one of an unknown type is an
attachment of kind "other" and one token; turns of equal number keep the order of their attachments' numbers,
then of their formatted text; null turns come first; a row without conv_id is a conversation of its own;
repeated rows are turns each; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    r"""Backslashes are doubled, then ``<|`` becomes ``<\|``: no control string is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text) if "\\" in text else text


class PartVisitor:
    """Flattens typed parts; `attachments` has (place, kind, ref, tokens) in order of appearance."""

    def __init__(self, first: int = 0, image_patch: int = 28, audio_tokens_a_second: float = 25.0, page_tokens: int = 256):
        """first: the number of the first attachment."""
        self.first = first
        self.image_patch, self.audio_rate, self.page_tokens = image_patch, audio_tokens_a_second, page_tokens
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = [math.ceil((part.get(k) or 0) / self.image_patch) for k in ("width", "height")]
        self._place("image", part, max(1, side[0] * side[1]))

    def visit_audio(self, part: dict) -> None:
        self._place("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._place("document", part, max(1, (part.get("pages") or 1) * self.page_tokens))

    def visit_other(self, part: dict) -> None:
        self._place("other", part, 1)

    def _place(self, kind: str, part: dict, tokens: int) -> None:
        place = f"<|{kind}_{self.first + len(self.attachments)}|>"
        self.out.append(place)
        self.attachments.append({"place": place, "kind": kind, "ref": part.get("ref"), "tokens": tokens})


def format_turn(role: str, parts: list[dict], visitor: PartVisitor | None = None) -> dict:
    """One turn's piece of the conversation: piece, loss_start and loss_size in code points of the
    piece (the content of assistant turns), attachments and expanded_tokens."""
    visitor = visitor or PartVisitor()
    for p in parts:
        visitor.visit(p)
    head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", "".join(visitor.out)
    lost = role == "assistant"
    return {"piece": f"{head}{body}{END}\n", "loss_start": len(head), "loss_size": len(body) if lost else 0, "attachments": visitor.attachments, "expanded_tokens": sum(a["tokens"] for a in visitor.attachments)}


def _plain_role(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders stay in the text."""
    if not piece.startswith(START) or not piece.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    role, _, body = piece[len(START) : -len(END) - 1].partition("\n")
    return _plain_role(role), unescape(body)


_PIECES = "conv_id long, turn long, piece string, loss_start long, loss_size long, first long, attachments string, n_attachments long, expanded_tokens long"


def format_turns(turns: DataFrame) -> DataFrame:
    """A formatted piece for each row of (conv_id, turn, role, text[, parts]).

    parts: array of structs with type and text, ref, width, height, seconds or pages; where it is
    null or missing, the text is the only part. A conversation is its pieces in order of (turn, first,
    piece), first being the number of attachments before. attachments: JSON of place, kind, ref, tokens.
    """
    has_parts = "parts" in turns.columns
    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), *([F.col("parts")] if has_parts else [])]
    rows = turns.select(*cols)
    if has_parts:
        own = F.coalesce(F.size(F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("text")) != "text")), F.lit(0))
        by = Window.partitionBy("conv_id", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text", F.to_json("parts"))), F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
        own = F.greatest(own, F.lit(0)).cast("long")
        rows = rows.withColumn("own", own).withColumn("first", F.sum("own").over(by.orderBy("turn", "role", "text", F.to_json("parts")).rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn("first", F.coalesce("first", F.lit(0))).drop("own")
    else:
        rows = rows.withColumn("first", F.lit(0).cast("long"))

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            parts = rows.get("parts") or [None] * batch.num_rows
            made = [format_turn(r or "", p if p is not None else [{"type": "text", "text": t}], PartVisitor(n)) for r, t, p, n in zip(rows["role"], rows["text"], parts, rows["first"])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([m["piece"] for m in made], pa.string()), pa.array([m["loss_start"] for m in made], pa.int64()),
                pa.array([m["loss_size"] for m in made], pa.int64()), pa.array(rows["first"], pa.int64()), pa.array([json.dumps(m["attachments"]) for m in made], pa.string()), pa.array([len(m["attachments"]) for m in made], pa.int64()), pa.array([m["expanded_tokens"] for m in made], pa.int64()),
            ], names=[c.split()[0] for c in _PIECES.split(", ")])

    return rows.mapInArrow(run, _PIECES)


def conversation_digest(pieces: DataFrame) -> DataFrame:
    """Read formatted pieces back, one row for each conversation.

    Turns of a conversation stream through running hashes in their order, so memory does not grow
    with its length; only its own rows must meet in one task, as a hash of a sequence needs.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"

    def run(batches):
        now, state = object(), None

        def close():
            conv, n, turns, chars, loss, *sizes = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), *sizes)

        done = []
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            d = batch.to_pydict()
            for conv, piece, at, n, attached, tokens in zip(d["conv_id"], d["piece"], d["loss_start"], d["loss_size"], d["n_attachments"], d["expanded_tokens"]):
                if state is None or conv is None or conv != now:
                    if state is not None:
                        done.append(close())
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text = read_turn(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                masked = unescape(piece[at : at + n])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5:] = state[5] + len(piece), state[6] + attached, state[7] + tokens
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done = []
        if state is not None:
            done.append(close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("piece"))  # spreads the rows without conv_id
    rows = pieces.select("conv_id", "turn", "first", "piece", "loss_start", "loss_size", "n_attachments", "expanded_tokens")
    return rows.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "first", "piece").mapInArrow(run, schema)
