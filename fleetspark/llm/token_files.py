"""Token ids of a corpus in compressed files, and back.

A file is a table of frames in ascending order of document ids. A frame holds whole documents; its ids are dealt into blocks
that are coded by the range coder each for itself, with a checksum each.
"""

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .range_coder import LANES, decode, encode
from .shared import NO_ID, table, written
from .tokens import BEFORE_SPACES, worker_encoder
from .words import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0

# Ids after which a frame ends with the document, and ids of a block.
FRAME_IDS = 1 << 16
BLOCK_IDS = 1 << 11
# Digits of four bits that an id has.
DIGITS = 4

_MAGIC = b"IDS1"
# Magic, documents, blocks, and a checksum of their numbers and the rest of the frame.
_HEAD = "<4sIII"


class DamagedFrame(ValueError):
    """A frame whose checksums do not match."""


def frame_of(doc_ids: np.ndarray, counts: np.ndarray, blocks: list[np.ndarray], codes: list[bytes]) -> bytes:
    """A frame: its head, the documents' ids and lengths, the blocks' lengths, checksums and sizes, and their codes."""
    sums = [zlib.crc32(b.astype("<u4").tobytes()) for b in blocks]
    about = np.array([[len(b), s, len(c)] for b, s, c in zip(blocks, sums, codes)], "<u4")
    body = doc_ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes() + about.tobytes() + b"".join(codes)
    checksum = zlib.crc32(body, zlib.crc32(struct.pack("<II", len(doc_ids), len(blocks))))
    return struct.pack(_HEAD, _MAGIC, len(doc_ids), len(blocks), checksum) + body


def parts_of(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Documents' ids and lengths, and what is known of each block (ids, checksum) with its code."""
    magic, n_docs, n_blocks, checksum = struct.unpack_from(_HEAD, frame)
    body = memoryview(frame)[struct.calcsize(_HEAD) :]
    if magic != _MAGIC or zlib.crc32(body, zlib.crc32(struct.pack("<II", n_docs, n_blocks))) != checksum:
        raise DamagedFrame("the frame is damaged")
    at = struct.calcsize(_HEAD)
    doc_ids = np.frombuffer(frame, "<i8", n_docs, at)
    counts = np.frombuffer(frame, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    about = np.frombuffer(frame, "<u4", 3 * n_blocks, at).reshape(n_blocks, 3).astype(np.int64)
    at += 12 * n_blocks
    ends = at + np.cumsum(about[:, 2])
    return doc_ids, counts, about[:, :2], [frame[e - n : e] for e, n in zip(ends.tolist(), about[:, 2].tolist())]


def _blocks(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]


def _coded(frames: list[tuple], digits: int) -> list[bytes]:
    """Frames from lists of document ids, lengths and ids; all their blocks are coded side by side."""
    dealt = [_blocks(ids) for _, _, ids in frames]
    codes = iter(encode([b for blocks in dealt for b in blocks], digits))
    return [
        frame_of(np.array(docs, np.int64), np.array(counts, np.int64), blocks, [next(codes) for _ in blocks])
        for (docs, counts, _), blocks in zip(frames, dealt)
    ]


def encoded(
    docs: DataFrame, tokenizer: str = TOKENIZER, cuts: str = BEFORE_SPACES, end_id: int = END_ID, digits: int = DIGITS
) -> DataFrame:
    """The frames of all documents: `part` and `frame` number, `before` (ids of the part before it), `n_ids` and `payload`.

    Documents are in ascending order of ids, over the whole table: parts are ranges of ids, and each part numbers its frames.
    Documents of equal id are in the order of a hash of their texts; a null id comes last. Null and empty texts are the end id
    alone; repeated rows are written each. Other columns are not read; an empty table gives an empty result. A frame is one
    document at least, so a very long text makes one large frame of many blocks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer, cuts), TaskContext.get().partitionId()
        frame, before = 0, 0
        docs, counts, held, size = [], [], [], 0
        full: list[tuple] = []

        def close() -> None:
            nonlocal docs, counts, held, size
            if docs:
                full.append((docs, counts, np.concatenate(held)))
            docs, counts, held, size = [], [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal full, frame, before
            out = []
            for (_, _, ids), payload in zip(full, _coded(full, digits)):
                out.append((part, frame, before, len(ids), payload))
                frame, before = frame + 1, before + len(ids)
            full = []
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "frame", "before", "n_ids", "payload"]
            )

        for batch in batches:
            for some in slices(batch, "text"):
                ids, lengths = encoder.encode(some.column("text"))
                if len(ids) and int(ids.max()) >> (4 * digits):
                    raise ValueError(f"an id has more than {digits} digits of four bits")
                at = 0
                for doc_id, n in zip(some.column("_id").to_pylist(), lengths.tolist()):
                    docs.append(doc_id)
                    counts.append(n + 1)
                    held.append(np.r_[ids[at : at + n], np.uint32(end_id)].astype(np.uint32))
                    at, size = at + n, size + n + 1
                    if size >= FRAME_IDS:
                        close()
                if sum(len(f[2]) for f in full) >= LANES * BLOCK_IDS:
                    yield emit()
        close()
        if full:
            yield emit()

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "text")
    # Rows of equal id, and rows equal in everything, may fill several parts.
    keyed = keyed.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    in_order = keyed.repartitionByRange("_id", "_tie", "_row").sortWithinPartitions("_id", "_tie")
    return in_order.select("_id", "text").mapInArrow(rows, "part int, frame long, before long, n_ids long, payload binary")


def decoded(frames: DataFrame, digits: int = DIGITS, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, `start` (the ids of all documents before it), `n_tokens`, `ids_crc32` and, on demand, `ids`.

    Each frame is read for itself. What comes before a part follows from the sums of the parts, of which there are as many as
    tasks wrote them. A damaged frame or block raises DamagedFrame.
    """
    sums = frames.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    sooner = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n_ids").over(sooner), F.lit(0)).alias("_start"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
                held.append((start, *parts_of(payload.as_py())))
                n += len(held[-1][4])
                if n >= LANES:
                    yield _documents(held, digits, with_ids)
                    held, n = [], 0
            if held:
                yield _documents(held, digits, with_ids)

    named = frames.join(F.broadcast(starts), "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return named.select((F.col("_start") + F.col("before")).alias("start"), "payload").mapInArrow(rows, schema)


def _documents(frames: list[tuple], digits: int, with_ids: bool) -> pa.RecordBatch:
    codes = [c for *_, own in frames for c in own]
    about = np.concatenate([a for _, _, _, a, _ in frames])
    blocks = decode(codes, about[:, 0].tolist(), digits)
    if any(zlib.crc32(b.astype("<u4").tobytes()) != s for b, s in zip(blocks, about[:, 1].tolist())):
        raise DamagedFrame("a block is damaged")
    out, at = [], 0
    for start, doc_ids, counts, own, _ in frames:
        ids = np.concatenate(blocks[at : at + len(own)]).astype("<u4")
        at += len(own)
        ends = np.cumsum(counts)
        for doc_id, n, end in zip(doc_ids.tolist(), counts.tolist(), ends.tolist()):
            mine = ids[end - n : end]
            out.append((None if doc_id == NO_ID else doc_id, start + end - n, n, zlib.crc32(mine.tobytes()), mine))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(4)]
    if with_ids:
        names.append("ids")
        columns.append(pa.array([o[4].astype(np.int32) for o in out], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids in compressed files, and read back."""
    return decoded(written(encoded(table(spark, sf_dir, "documents")), "token-files"))
