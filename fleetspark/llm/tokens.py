"""Token ids of whole texts, with the public tokenizer files.

Most of a corpus is made of words that come again and again. A text is cut where the tokenizer cuts in any case, and each
distinct piece is encoded once in a while, not at each place where it stands. The ids are those of the whole text.
"""

import itertools
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from .words import text_bytes, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pieces that a worker remembers, some 50 bytes each, and the longest of them in bytes. Others are encoded anew.
REMEMBERED = 1_000_000
LONGEST = 64

# Letters, or letters and then marks: a tokenizer makes one word of each run, so such pieces can be encoded in one text.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?]+)?")
# Pieces of one such text.
_TOGETHER = 256

# Where a text may be cut: a byte-level tokenizer starts a token at each space that something visible follows; one that
# drops white space never joins anything over it.
BEFORE_SPACES, AT_SPACES = "before spaces", "at spaces"

# A space before white space or at the end, where the first rule does not hold.
_ODD_SPACE = r" ([\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|$)"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers:
    """Numbers of remembered pieces, by hash, length and first bytes, in sorted arrays of which one is small."""

    def __init__(self) -> None:
        none = np.zeros(0, np.uint64)
        self._parts = [(none, none, np.zeros(0, np.int64))] * 2

    def __len__(self) -> int:
        return sum(len(keys) for keys, _, _ in self._parts)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1. A piece is told by its key and its check."""
        found = np.full(len(keys), -1, np.int64)
        for own, own_checks, numbers in self._parts:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = (own[at] == keys) & (own_checks[at] == checks)
                found[hit] = numbers[at[hit]]
        return found

    def add(self, keys: np.ndarray, checks: np.ndarray, numbers: np.ndarray) -> None:
        large, small = self._parts
        small = self._merged(small, (keys, checks, numbers))
        if len(small[0]) > max(50_000, len(large[0]) // 4):
            large, small = self._merged(large, small), tuple(x[:0] for x in small)
        self._parts = [large, small]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        columns = [np.concatenate(pair) for pair in zip(a, b)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self._own, self._filled = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self._filled

    def add(self, values: np.ndarray) -> None:
        end = self._filled + len(values)
        if end > len(self._own):
            larger = np.zeros(max(end, 2 * len(self._own)), self._own.dtype)
            larger[: self._filled] = self.all
            self._own = larger
        self._own[self._filled : end] = values
        self._filled = end

    @property
    def all(self) -> np.ndarray:
        return self._own[: self._filled]


class _Memory:
    """The ids of pieces, by their numbers; short pieces are found again."""

    def __init__(self) -> None:
        self._known = _Numbers()
        self._flat, self._starts, self._lengths = _Grown(np.uint32), _Grown(np.int64), _Grown(np.int64)

    @property
    def full(self) -> bool:
        return max(len(self._known), len(self._starts) // 2) > REMEMBERED // 2

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        return self._known.find(keys, checks)

    def add(self, keys: np.ndarray, checks: np.ndarray, kept: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers of new pieces, of which those `kept` are found again."""
        numbers = len(self._starts) + np.arange(len(keys))
        self._starts.add(len(self._flat) + np.cumsum(lengths) - lengths)
        self._flat.add(flat)
        self._lengths.add(lengths)
        self._known.add(keys[kept], checks[kept], numbers[kept])
        return numbers

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these pieces in a row, and how many each has."""
        lengths = self._lengths.all[numbers]
        ends = np.cumsum(lengths)
        places = np.repeat(self._starts.all[numbers] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
        return self._flat.all[places], lengths


class Encoder:
    """Encodes lists of texts; remembers the ids of frequent pieces.

    There are two memories. When the young one is full it becomes the old one. A piece that is met again moves from the old one
    into the young one, so what comes again and again is never forgotten, and what came once is.
    """

    def __init__(self, file: str, cuts: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path(file))
        self._cuts = cuts
        self._young, self._old = _Memory(), _Memory()
        # Ids that begin with a space, or that end a word.
        vocabulary = self._tokenizer.get_vocab()
        self._marks = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self._marks[number] = token.startswith("Ġ") if cuts == BEFORE_SPACES else token.endswith("</w>")

    def _direct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        lists = [x.ids for x in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which the pieces are taken, their ids in a row in this order, and how many each has.

        Plain pieces are encoded many at once, which takes half the time, and told apart by where words begin or end.
        """
        spaces = self._cuts == BEFORE_SPACES
        matches = [_PLAIN.fullmatch(p) for p in pieces]
        plain = [i for i, m in enumerate(matches) if m is not None and (not spaces or pieces[i][0] == " ")]
        others = [i for i, m in enumerate(matches) if m is None or (spaces and pieces[i][0] != " ")]
        glue = "" if spaces else " "
        groups = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        texts = [glue.join([pieces[i] for i in group]) for group in groups]
        order, flats, sizes = [], [], []
        for group, text in zip(groups, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(text.ids, np.uint32)
            marks = np.flatnonzero(self._marks[ids])
            if spaces:
                right, cuts = len(marks) == len(group) and marks[0] == 0, np.r_[marks, len(ids)]
            else:
                words = np.cumsum([2 if matches[i].group(1) else 1 for i in group])
                right = len(marks) == words[-1] and marks[-1] + 1 == len(ids)
                cuts = np.r_[0, marks[words - 1] + 1] if right else None
            if right:
                order += group
                flats.append(ids)
                sizes.append(np.diff(cuts))
            else:
                others += group
        flat, lengths = self._direct([pieces[i] for i in others])
        return np.array(order + others, np.int64), np.concatenate([*flats, flat]), np.concatenate([*sizes, lengths])

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, for texts that may be cut at every space."""
        if self._young.full:
            self._young, self._old = _Memory(), self._young
        spaces = self._cuts == BEFORE_SPACES
        raw, at = text_bytes(texts)
        words = words_of(texts, seed=6, at_spaces=spaces)
        if len(words.hash) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # A space before the piece belongs to it.
        begin = words.begin - (spaces & (words.begin > at[words.text]))
        keys, first, piece = np.unique(words.hash ^ (words.begin - begin).astype(np.uint64), return_index=True, return_inverse=True)
        begin, size = begin[first], words.end[first] - begin[first]
        # The first bytes and the length, so that pieces of up to seven bytes are told apart without their hash.
        checks = (size & 255).astype(np.uint64)
        for i in range(7):
            byte = raw[np.minimum(begin + i, len(raw) - 1)].astype(np.uint64)
            checks |= np.where(i < size, byte, 0).astype(np.uint64) << np.uint64(8 * i + 8)
        numbers = self._young.find(keys, checks)
        fresh = np.flatnonzero(numbers < 0)
        older = self._old.find(keys[fresh], checks[fresh])
        again, fresh = fresh[older >= 0], fresh[older < 0]
        if len(again):
            everyone = np.ones(len(again), bool)
            numbers[again] = self._young.add(keys[again], checks[again], everyone, *self._old.ids(older[older >= 0]))
        if len(fresh):
            data = raw.tobytes()
            pieces = [data[a : a + n].decode() for a, n in zip(begin[fresh].tolist(), size[fresh].tolist())]
            order, flat, lengths = self._new(pieces)
            fresh = fresh[order]
            numbers[fresh] = self._young.add(keys[fresh], checks[fresh], size[fresh] <= LONGEST, flat, lengths)
        ids, lengths = self._young.ids(numbers[piece])
        return ids, np.diff(np.r_[0, np.cumsum(lengths)][words.first])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has. A null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        if self._cuts == AT_SPACES or len(texts) == 0:
            return self._by_pieces(texts)
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        if not pc.any(odd).as_py():
            return self._by_pieces(texts)
        ids, counts = self._by_pieces(pc.if_else(odd, "", texts))
        odd = odd.to_numpy(zero_copy_only=False)
        own, lengths = self._direct(texts.filter(pa.array(odd)).to_pylist())
        # The ids of odd texts go where these had none.
        gaps = np.cumsum(counts)[odd]
        ids = np.insert(ids, np.repeat(gaps, lengths), own)
        counts[odd] = lengths
        return ids, counts


def worker_encoder(file: str, cuts: str) -> Encoder:
    """The encoder of this worker process; later tasks of the process find what it remembers."""
    kept = sys.modules.setdefault("_fleetspark_encoders", types.ModuleType("_fleetspark_encoders"))
    if not hasattr(kept, file):
        setattr(kept, file, Encoder(file, cuts))
    return getattr(kept, file)
