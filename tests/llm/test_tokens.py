import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fleetspark.llm import packing, range_coder, token_files, tokens
from fleetspark.llm.shared import written
from tokenizers import Tokenizer

CASES = [("word_bpe_49k.json", tokens.AT_SPACES), ("byte_bpe_50k.json", tokens.BEFORE_SPACES)]


def plain(file, texts):
    encoded = Tokenizer.from_file(tokens.tokenizer_path(file)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in encoded]


@pytest.mark.parametrize("file, cuts", CASES)
def test_ids_are_those_of_whole_texts(small, file, cuts, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    chance = random.Random(3)
    odd = ["", " ", "  a", "a\n\nb c' s don't  x ", "end ", " \n", "<|endoftext|> x", "x" * 300, "\x1c \x85 b", None]
    odd += ["".join(chance.choice(" \n\ta'sé漢1.!　") for _ in range(chance.randrange(30))) for _ in range(500)]
    encoder = tokens.Encoder(file, cuts)
    for texts in (odd, list(small[1].values()), odd, []):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == plain(file, texts)


@pytest.mark.parametrize("digits, top", [(4, 65535), (4, 40), (5, 100_000), (1, 15)])
def test_coder_round_trip(digits, top):
    chance = np.random.default_rng(top)
    blocks = [chance.integers(0, top + 1, n).astype(np.uint32) for n in (0, 1, 2, 700, 33)]
    blocks += [np.full(900, top, np.uint32), np.arange(500, dtype=np.uint32) % (top + 1), np.zeros(3, np.uint32)]
    codes = range_coder.encode(blocks, digits)
    back = range_coder.decode(codes, [len(b) for b in blocks], digits)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    # Blocks are independent: alone they have the same code.
    assert range_coder.encode(blocks[3:4], digits) == codes[3:4]
    assert len(codes[5]) < 900 / 4
    assert range_coder.encode([], digits) == [] == range_coder.decode([], [], digits)


def test_contexts_help():
    chance = np.random.default_rng(5)
    follows = chance.integers(0, 50_000, 300)
    ids = follows[np.cumsum(chance.integers(1, 3, 8000)) % 300].astype(np.uint32)
    (code,) = range_coder.encode([ids], 4)
    (shuffled,) = range_coder.encode([chance.permutation(ids)], 4)
    assert len(code) < 0.75 * len(shuffled) < 0.75 * 2 * len(ids)


def expected(docs, file, end):
    rows = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    return [(r[0], np.array([*ids, end], "<u4")) for r, ids in zip(rows, plain(file, [r[1] for r in rows]))]


def test_files_round_trip(spark, small, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 3000)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)
    docs, texts = small
    frames = written(token_files.encoded(docs.repartition(5)), "test")
    rows = sorted(token_files.decoded(frames, with_ids=True).collect())
    start = 0
    for row, (doc_id, ids) in zip(rows, expected(list(texts.items()), "byte_bpe_50k.json", 0), strict=True):
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        assert row.ids == ids.tolist()
        start += len(ids)
    size = sum(len(r.payload) for r in frames.collect())
    assert size < 2 * start * 0.8


def test_damage_is_found():
    ids = np.arange(2500, dtype=np.uint32)
    (frame,) = token_files._coded([([1, 2], [2000, 500], ids)], 4)
    doc_ids, counts, about, codes = token_files.parts_of(frame)
    assert doc_ids.tolist() == [1, 2] and counts.tolist() == [2000, 500] and about[:, 0].sum() == 2500
    for at in (0, 5, 20, len(frame) - 1):
        broken = bytearray(frame)
        broken[at] ^= 1
        with pytest.raises(token_files.DamagedFrame):
            token_files.parts_of(bytes(broken))
    about[0, 1] ^= 1
    with pytest.raises(token_files.DamagedFrame):
        token_files._documents([(0, doc_ids, counts, about, codes)], 4, False)


def test_hard_rows_in_files(hard, hard_rows, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 4000)
    rows = token_files.decoded(written(token_files.encoded(hard), "test")).collect()
    wanted = expected(hard_rows, "byte_bpe_50k.json", 0)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids_crc32) for r in rows), key=key) == sorted(
        ((d, zlib.crc32(i.tobytes())) for d, i in wanted), key=key
    )
    by_start = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [d for d, _ in wanted]
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start])[:-1].tolist()


def test_empty_tables(empty):
    assert token_files.decoded(written(token_files.encoded(empty), "test")).count() == 0
    assert packing.pack(empty).count() == 0


def check_pieces(rows, wanted, max_tokens, max_segments):
    """Each id lies in one piece, sequences have no gaps and keep the limits, and little is padded."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, ids in wanted:
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids == ids[at : at + r.length].tolist() and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total <= max_tokens and len(own) <= max_segments
        assert own[0].padded_length == (total if total & (total - 1) == 0 else max_tokens)
        padding += own[0].padded_length - total
    return padding, sum(r.length for r in rows)


@pytest.mark.parametrize("limits", [(4096, 64), (256, 64), (256, 2), (100, 1)])
def test_packing(small, limits):
    docs, texts = small
    rows = packing.pack(docs.repartition(3), max_tokens=limits[0], max_segments=limits[1], max_loss=limits[0]).collect()
    padding, total = check_pieces(rows, expected(list(texts.items()), "word_bpe_49k.json", 2), *limits)
    if limits[1] == 64:
        assert padding == 0


def test_short_documents_are_not_padded(spark):
    """Documents so short that the limit on segments closes every sequence."""
    rows = [(i, "one two three four five") for i in range(20_000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    lengths = {}
    for r in found:
        lengths.setdefault(r.sequence_id, []).append(r)
    total = sum(r.length for r in found)
    assert total == 120_000 and all(len(own) <= 64 for own in lengths.values())
    assert sum(own[0].padded_length for own in lengths.values()) <= 1.01 * total


def test_loss_limit(spark):
    rows = [(i, "a b c d e f g h i j", 4) for i in range(40)] + [(99, "a b c " * 100, None), (100, "x " * 300, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss_start int")
    found = packing.pack(docs.coalesce(1), max_tokens=64, max_segments=8, max_loss=30).collect()
    starts = {i: s or 0 for i, _, s in rows}
    loss = {}
    for r in found:
        bears = max(0, r.start + r.length - max(r.start, starts[r.doc_id]))
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + bears
    assert max(loss.values()) <= 30
    check_pieces(found, expected([(i, t) for i, t, _ in rows], "word_bpe_49k.json", 2), 64, 8)


def test_hard_rows_packed(hard, hard_rows):
    rows = packing.pack(hard).collect()
    wanted = sum(len(i) for _, i in expected(hard_rows, "word_bpe_49k.json", 2))
    assert sum(r.length for r in rows) == wanted and sum(r.length == 1 and r.doc_tokens == 1 for r in rows) >= 4


def test_rows_without_id_fill_all_parts(spark):
    docs = spark.createDataFrame([(None, f"text {i % 2000} of many") for i in range(4000)], "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frames = token_files.encoded(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = {}
    for f in frames:
        sizes[f.part] = sizes.get(f.part, 0) + f.n_ids
    assert max(sizes.values()) <= 2 * sum(sizes.values()) / 8
