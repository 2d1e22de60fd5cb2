"""Vector bin packing of examples into training sequences (operator 1).

An example is a vector of demands: tokens, one segment, and loss-bearing tokens; a sequence has
a capacity for each.  Every scan task streams its examples through a pool of bounded size and
fills one open sequence at a time with the dot-product heuristic: of the examples that fit, take
the one whose demands, each divided by its capacity, have the largest dot product with what
the sequence has left.  It prefers examples that use up whatever is most plentiful.

With ``cut=True`` examples may be cut: text longer than a sequence fills whole sequences first,
and a sequence that no whole example fits is closed with the head of a pooled one, whose tail
goes back to the pool.  What is left of a task at its end is packed into sequences whose sizes are
powers of two, which need no padding.  Sequences are numbered by task, so no shuffle is needed.

Defined cases: a null text is empty and has only the closing token; a null id is an ordinary
value; repeated rows are packed as often as they occur; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwork.llm.wordbpe import WordEncoder

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "loss_tokens long, sequence_tokens long"
)
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens",
           "sequence_tokens")
#: Sequence numbers are task number times this plus a running number.
TASK_STRIDE = 1 << 40


class Piece:
    """Some consecutive tokens of one example."""

    __slots__ = ("doc", "ids", "loss", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int, loss: np.ndarray):
        self.doc, self.start, self.ids, self.total, self.loss = doc, start, ids, total, loss

    def split(self, at: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, self.ids[:at], self.total, self.loss[:at])
        return head, Piece(self.doc, self.start + at, self.ids[at:], self.total, self.loss[at:])


class Packer:
    """Fills sequences from a pool of pieces under several capacities at once."""

    def __init__(self, capacity: tuple[int, int, int], cut: bool, pool: int, first: int):
        self.capacity = np.array(capacity, dtype=np.float64)
        self.cut, self.limit, self.number = cut, pool, first
        self.pool: list[Piece] = []
        self.demand = np.zeros((2 * pool + 64, 3))
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        at, size = 0, sum(len(p.ids) for p in pieces)
        for p in pieces:
            crc = zlib.crc32(p.ids.tobytes())
            self.rows.append((p.doc, p.start, len(p.ids), crc, p.total, self.number, at, int(p.loss.sum()), size))
            at += len(p.ids)
        self.number += 1

    def add(self, piece: Piece) -> None:
        tokens, loss = int(self.capacity[0]), int(self.capacity[2])
        if not self.cut and (len(piece.ids) > tokens or piece.loss.sum() > loss):
            raise ValueError(f"example {piece.doc} exceeds a sequence; allow cuts or raise the capacity")
        while len(piece.ids) >= tokens and piece.loss[:tokens].sum() <= loss:
            head, piece = piece.split(tokens)
            self.emit([head])
        if len(piece.ids):
            self.put(piece)
        while len(self.pool) >= self.limit:
            self.emit(self.fill())

    def put(self, piece: Piece) -> None:
        self.demand[len(self.pool)] = (len(piece.ids), 1, piece.loss.sum())
        self.pool.append(piece)
        if len(self.pool) == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])

    def take(self, i: int) -> Piece:
        piece, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i] = last
            self.demand[i] = self.demand[len(self.pool)]
        return piece

    def fill(self, target: int | None = None) -> list[Piece]:
        """One sequence from the pool, of at most ``target`` tokens."""
        left = self.capacity.copy()
        if target is not None:
            left[0] = target
        out: list[Piece] = []
        while self.pool and left[0] > 0 and left[1] > 0:
            demand = self.demand[: len(self.pool)]
            fits = (demand <= left).all(axis=1)
            if self.cut and left[1] == 1:
                fits &= demand[:, 0] == left[0]  # the last segment has to close the sequence
            if fits.any():
                score = (demand / self.capacity) @ (left / self.capacity)
                piece = self.take(int(np.argmax(np.where(fits, score, -1.0))))
            elif self.cut:
                piece = self.head(left)
                if piece is None:
                    break
            else:
                break
            left -= (len(piece.ids), 1, piece.loss.sum())
            out.append(piece)
        return out

    def head(self, left: np.ndarray) -> Piece | None:
        """Cut the longest pooled piece to what the sequence still holds."""
        i = int(np.argmax(self.demand[: len(self.pool), 0]))
        size = min(int(left[0]), len(self.pool[i].ids))
        size = min(size, int(np.searchsorted(np.cumsum(self.pool[i].loss), left[2], side="right")))
        if not size:
            return None
        head, tail = self.take(i).split(size)
        if len(tail.ids):
            self.put(tail)
        return head

    def finish(self) -> None:
        while self.pool:
            rest = int(self.demand[: len(self.pool), 0].sum())
            if not self.cut or rest >= self.capacity[0]:
                self.emit(self.fill())
            else:  # powers of two need no padding
                self.emit(self.fill(1 << (rest.bit_length() - 1)))

    def drain(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if not rows:
            return None
        columns = zip(*rows, strict=True)
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=list(_FIELDS))


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    max_tokens: int = 2048,
    max_segments: int = 256,
    max_loss_tokens: int | None = None,
    end_id: int = 1,
    cut: bool = True,
    pool: int = 256,
) -> DataFrame:
    """Pieces (see ``PIECES``) of every example, each token in exactly one.

    The tokens of ``prompt_col`` come first and bear no loss; those of ``text_col`` and the closing
    ``end_id`` do.  A sequence holds at most ``max_tokens`` tokens, ``max_segments`` pieces and
    ``max_loss_tokens`` loss-bearing tokens (default: ``max_tokens``).  Without ``cut`` an example
    beyond a capacity is an error.  ``pool`` bounds the examples that a task holds.
    """
    capacity = (max_tokens, max_segments, max_tokens if max_loss_tokens is None else max_loss_tokens)
    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), prompt.alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(tokenizer)
        packer = Packer(capacity, cut, pool, TaskContext.get().partitionId() * TASK_STRIDE)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = encode(part.column(1).to_pylist())
                prompts = encode(part.column(2).to_pylist()) if prompt_col else [end[:0]] * len(texts)
                for doc, text, before in zip(part.column(0).to_pylist(), texts, prompts, strict=True):
                    ids = np.concatenate([before, text, end])
                    loss = np.ones(len(ids), dtype=np.int64)
                    loss[: len(before)] = 0
                    packer.add(Piece(doc, 0, ids, len(ids), loss))
                if (out := packer.drain()) is not None:
                    yield out
        packer.finish()
        if (out := packer.drain()) is not None:
            yield out

    return rows.mapInArrow(run, PIECES)
