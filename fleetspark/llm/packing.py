"""Packing documents into training sequences: vector bin packing by the dot-product heuristic.

A sequence has limits on tokens, on segments and on tokens that bear loss. Among the examples that still fit, the one whose
demand has the largest dot product with what is left of the limits goes in next.
"""

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .tokens import AT_SPACES, worker_encoder
from .words import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAX_TOKENS = 4096
MAX_SEGMENTS = 64
MAX_LOSS = 4096

# Examples that a task chooses from at once, a bound on its memory together with the size of a text.
POOL = 512
_FREE = 1 << 62

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


class _Packer:
    """Packs the examples of one task. An example is cut where a sequence would else stay part empty."""

    def __init__(self, limits: tuple[int, int, int], first_sequence: int, with_ids: bool):
        self._limits = np.array(limits, np.int64)
        self._sequence, self._with_ids = first_sequence, with_ids
        # Of each slot: the example (its id, ids, first loss-bearing id and start), tokens left and loss-bearing tokens left.
        self._examples: list[tuple | None] = [None] * (POOL + 1)
        self._free = list(range(POOL, -1, -1))
        # A free slot has more tokens than any sequence takes.
        self._tokens = np.full(POOL + 1, _FREE, np.int64)
        self._loss = np.zeros(POOL + 1, np.int64)
        self._open()
        self.out: list[tuple] = []

    def _open(self) -> None:
        self._left, self._pieces = self._limits.tolist(), []

    def add(self, doc_id, ids: np.ndarray, loss_start: int) -> None:
        """One more example, whose tokens bear loss from `loss_start` on. There must be room for it in the pool."""
        loss_start = min(max(loss_start, 0), len(ids))
        slot = self._free.pop()
        self._examples[slot] = (doc_id, ids, loss_start, 0)
        self._tokens[slot], self._loss[slot] = len(ids), len(ids) - loss_start

    @property
    def pending(self) -> int:
        return len(self._examples) - len(self._free)

    def place(self) -> None:
        """Places one example, or as much of the longest as goes in, or closes the sequence when nothing does."""
        tokens, segments, loss = self._left
        most, _, most_loss = self._limits.tolist()
        fits = self._tokens <= tokens
        if most_loss < most or loss < tokens:
            fits &= self._loss <= loss
        # The demand for a segment is the same for all, so it does not change which product is the largest.
        product = self._tokens * (tokens / most / most) + self._loss * (loss / most_loss / most_loss)
        best = int(np.argmax(np.where(fits, product, -1.0)))
        if fits[best]:
            self._take(best, int(self._tokens[best]))
        else:
            longest = int(np.argmax(np.where(self._tokens < _FREE, self._tokens, -1)))
            left, bearing = int(self._tokens[longest]), int(self._loss[longest])
            room = min(tokens, left, left - bearing + loss)
            if not room:
                self.close()
                return
            self._take(longest, room)
        if not self._left[0] or not self._left[1]:
            self.close()

    def _take(self, slot: int, n: int) -> None:
        doc_id, ids, loss_start, start = self._examples[slot]
        bearing = max(0, start + n - max(start, loss_start))
        self._pieces.append((doc_id, start, ids[start : start + n], len(ids)))
        self._left = [self._left[0] - n, self._left[1] - 1, self._left[2] - bearing]
        if start + n == len(ids):
            self._examples[slot] = None
            self._tokens[slot], self._loss[slot] = _FREE, 0
            self._free.append(slot)
        else:
            self._examples[slot] = (doc_id, ids, loss_start, start + n)
            self._tokens[slot] -= n
            self._loss[slot] -= bearing

    def close(self) -> None:
        """Ends the sequence. One that is not full is cut into lengths that are powers of two, so it needs no padding."""
        pieces = self._pieces[::-1]
        total = sum(len(ids) for _, _, ids, _ in pieces)
        while total:
            room, part = total if total == self._limits[0] else 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                doc_id, start, ids, whole = pieces.pop()
                part.append((doc_id, start, ids[:room], whole))
                if len(ids) > room:
                    pieces.append((doc_id, start + room, ids[room:], whole))
                room -= len(part[-1][2])
            self._emit(part)
        self._open()

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        padded = sum(len(ids) for _, _, ids, _ in pieces)
        for doc_id, start, ids, whole in pieces:
            row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, self._sequence, offset, padded)
            self.out.append((*row, ids) if self._with_ids else row)
            offset += len(ids)
        self._sequence += 1

    def finish(self) -> None:
        """Places what is left."""
        while self.pending:
            self.place()
        self.close()

    def rows(self) -> pa.RecordBatch | None:
        """The pieces of the sequences closed so far."""
        out, self.out = self.out, []
        if not out:
            return None
        names = [x.split()[0] for x in _PIECE.split(", ")]
        columns = [pa.array(c, pa.int64()) for c in list(zip(*out))[: len(names)]]
        if self._with_ids:
            names.append("ids")
            lengths = np.r_[0, np.cumsum([len(x[-1]) for x in out])].astype(np.int32)
            flat = np.concatenate([x[-1] for x in out]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, names)


def pack(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    cuts: str = AT_SPACES,
    end_id: int = END_ID,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document: its place in the document, in its sequence, and its token ids.

    A document is its ids and the end id. Documents are cut freely; each id lies in exactly one piece, and a sequence has no
    gaps. No sequence exceeds the three limits. One that a limit closes before it is full is cut into lengths that are powers of
    two, so no sequence needs padding. Where the documents have a column `loss_start`, only tokens from that number
    on bear loss, else all do (null: all).

    Each task packs the documents that it reads, so nothing is shuffled and no key can be hot. A task holds a few hundred
    examples. Sequences are numbered by task, so a task
    that runs again gives the same rows. Null text is empty, an empty text is the end id alone, repeated rows are packed each
    for itself, ids may be null, and an empty table gives an empty result. Other columns are not read.
    """
    limits = (max_tokens, max_segments, max_loss)
    if min(limits) < 1:
        raise ValueError("all limits must be positive")
    loss = F.coalesce(F.col("loss_start").cast("long"), F.lit(0)) if "loss_start" in docs.columns else F.lit(0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(limits, TaskContext.get().partitionId() << 40, with_ids)
        encoder = worker_encoder(tokenizer, cuts)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encoder.encode(part.column("text"))
                at = 0
                for doc_id, start, n in zip(part.column("doc_id").to_pylist(), part.column("loss").to_pylist(), counts.tolist()):
                    while packer.pending > POOL:
                        packer.place()
                    packer.add(doc_id, np.append(ids[at : at + n], np.uint32(end_id)), start)
                    at += n
                if (done := packer.rows()) is not None:
                    yield done
        packer.finish()
        if (done := packer.rows()) is not None:
            yield done

    schema = _PIECE + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", loss.cast("long").alias("loss")).mapInArrow(rows, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
