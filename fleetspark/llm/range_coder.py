"""An adaptive context-mixing range coder for token ids.

Three models predict the next id: order 2 the id that followed the two ids before when they last came, order 1 the id that
followed the id before, and order 0 a distribution over all ids, digit by digit of eight bits, lower digits in the context of
the higher ones. The three are mixed into one distribution: how much of the scale orders 2 and 1 give to their ids follows how
often ids foretold with such confidence have come, and order 0 has the rest. The mixture drives a range coder.

Many blocks are coded side by side, one id of each at a time, so that numpy works on long arrays. Blocks know nothing of each
other: the models of each begin anew. All arithmetic is on integers, so a decoder does exactly what the encoder did.
"""

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Contexts of orders 1 and 2 that a block remembers, as slots of hashed tables, and contexts of a lower digit.
SLOT_BITS = 10
ROWS = 8
# Blocks that are coded side by side, a bound on memory: each takes 18 KB. The more, the less a step costs per id.
LANES = 4096

_SYMBOLS = 256
_FLAG_BITS, _DIGIT_BITS = 12, 14
_FLAGS, _SCALE = 1 << _FLAG_BITS, 1 << _DIGIT_BITS

# A digit that comes counts so much against one for each digit at the start. Counts are halved beyond a total.
_GAIN, _MOST = 24, 40_000
# The distributions of order 0 follow their counts at these steps and then at each multiple of the last.
_RENEWED = (4, 8, 16, 32, 64, 128)
_RENEWED_ROWS = 2048

_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
_WORD = np.uint64(16)

# A slot holds an id and how far it is to be trusted: 0 for an empty slot, 1 for an id seen once, up to 3.
_TRUST = 4
# The trust after a miss (first half) and after a hit. A missed id stays while its trust was 2 or more.
_NEXT_TRUST = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.int32)
# What a share moves to. It never gets to nothing or to all of the scale.
_LEAST, _LARGEST = np.int32(16), np.int32(_FLAGS - 16)
# Order 1 has one level of trust more, for an id that order 2 foretells as well.
_STATES = _TRUST * (_TRUST + 1)


class _Models:
    """The models of all lanes."""

    def __init__(self, lanes: int, digits: int):
        self._lanes = np.arange(lanes, dtype=np.int64)
        self._slots = [np.zeros(lanes << SLOT_BITS, np.int32) for _ in range(2)]
        # The share of the scale that order 2, and order 1 of what is left, give to their ids in each state.
        self._shares = np.full((lanes * _STATES, 2), _FLAGS // 16, np.int16).view(np.int32).ravel()
        # The first digit has one row of counts, the others have ROWS each.
        self._rows = 1 + ROWS * (digits - 1)
        self._counts = np.ones((lanes * self._rows, _SYMBOLS), np.uint16)
        self._below = np.zeros((lanes * self._rows, _SYMBOLS + 1), np.uint16)
        self._renew(lanes)

    def _renew(self, n: int) -> None:
        """The cumulative frequencies of order 0 from the counts so far; every digit keeps some of the scale."""
        places = np.arange(1, _SYMBOLS + 1, dtype=np.uint32)
        # A few rows at a time, which stay in the cache.
        for at in range(0, n * self._rows, _RENEWED_ROWS):
            some = slice(at, min(at + _RENEWED_ROWS, n * self._rows))
            counts = self._counts[some]
            sums = np.cumsum(counts, axis=1, dtype=np.uint16)
            large = np.flatnonzero(sums[:, -1] > _MOST)
            if len(large):
                counts[large] -= counts[large] >> np.uint16(1)
                sums[large] = np.cumsum(counts[large], axis=1, dtype=np.uint16)
            upto = sums.astype(np.uint32)
            upto *= (np.uint32((_SCALE - _SYMBOLS) << 16) // upto[:, -1])[:, None]
            upto >>= np.uint32(16)
            upto += places
            upto[:, -1] = _SCALE
            self._below[some, 1:] = upto

    def begin(self, step: int, n: int) -> None:
        """To be called before each step, with the number of lanes that still run."""
        if step in _RENEWED or step and step % _RENEWED[-1] == 0:
            self._renew(n)

    def foretell(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids that orders 2 and 1 expect after the ids `one` and, before it, `two`, and their shares of the scale."""
        lanes = self._lanes[: len(one)]
        base = lanes << SLOT_BITS
        mixed = (one + np.uint32(1)) * np.uint32(0xC2B2AE35)
        first = mixed >> np.uint32(32 - SLOT_BITS)
        mixed ^= mixed >> np.uint32(15)
        mixed += (two + np.uint32(1)) * np.uint32(0x27D4EB2F)
        mixed *= np.uint32(0x9E3779B1)
        self._at = base + (mixed >> np.uint32(32 - SLOT_BITS)), base + first
        held = [slots.take(at) for slots, at in zip(self._slots, self._at)]
        self._ids = held[0] >> 2, held[1] >> 2
        self._trust = held[0] & 3, held[1] & 3
        agree = self._ids[0] == self._ids[1]
        self._state = lanes * _STATES + self._trust[0] * (_TRUST + 1) + np.where(agree, _TRUST, self._trust[1])
        given = self._shares.take(self._state)
        share, rest = self._given = given & 0xFFFF, given >> 16
        return *self._ids, share, (rest * (_FLAGS - share)) >> _FLAG_BITS

    def learn(self, now: np.ndarray, hit: np.ndarray, second: np.ndarray) -> None:
        """Takes in the ids that came; `hit` where order 2 expected them and `second` where only order 1 did."""
        share, rest = self._given
        share = share + ((np.where(hit, _LARGEST, _LEAST) - share) >> 5)
        rest = rest + np.where(hit, 0, (np.where(second, _LARGEST, _LEAST) - rest) >> 5)
        self._shares[self._state] = share | (rest << 16)
        for slots, at, ids, trust in zip(self._slots, self._at, self._ids, self._trust):
            came = ids == now
            kept = np.where(trust > 1, ids, now)
            slots[at] = (kept << 2) | _NEXT_TRUST.take((came << 2) + trust)

    def row(self, digit: int, higher: np.ndarray) -> np.ndarray:
        """The row of each lane for a digit, given the digits before as one number."""
        rows = self._lanes[: len(higher)] * self._rows
        return rows if digit == 0 else rows + (1 + ROWS * (digit - 1)) + np.minimum(higher, ROWS - 1)

    def interval(self, row: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where order 0 has the symbols on its scale: start and length."""
        at = row * (_SYMBOLS + 1) + symbol
        below = self._below.reshape(-1)
        start = below.take(at)
        return start, below.take(at + 1) - start

    def find(self, row: np.ndarray, aim: np.ndarray) -> np.ndarray:
        """The symbol of each lane whose interval holds `aim`."""
        below = self._below.reshape(-1)
        at = base = row * (_SYMBOLS + 1)
        for step in (128, 64, 32, 16, 8, 4, 2, 1):
            at = at + (below.take(at + step) <= aim) * step
        return at - base

    def count(self, row: np.ndarray, symbol: np.ndarray) -> None:
        """Takes in a digit that came."""
        at = row * _SYMBOLS + symbol
        counts = self._counts.reshape(-1)
        counts[at] = counts.take(at) + np.uint16(_GAIN)


def _order_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes by falling length, and how many of them still run at each step."""
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    steps = int(falling[0]) if len(falling) else 0
    return order, np.searchsorted(-falling, -np.arange(steps), "left")


def _octets(digits: int) -> int:
    return (digits + 1) // 2


def encode(blocks: list[np.ndarray], digits: int) -> list[bytes]:
    """The code of each block of ids below 16 ** digits."""
    out: list[bytes] = []
    for at in range(0, len(blocks), LANES):
        out += _encode(blocks[at : at + LANES], _octets(digits))
    return out


def _encode(blocks: list[np.ndarray], digits: int) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks], np.int64)
    order, running = _order_of(lengths)
    lanes, steps = len(blocks), len(running)
    ids = np.zeros((steps, lanes), np.uint32)
    for lane, i in enumerate(order.tolist()):
        ids[: len(blocks[i]), lane] = blocks[i]
    models = _Models(lanes, digits)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words = np.zeros((lanes, 64), np.uint16)
    filled = np.zeros(lanes, np.int64)
    one, two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def put(which: np.ndarray) -> None:
        nonlocal words
        if filled.max() >= words.shape[1]:
            words = np.concatenate((words, np.zeros_like(words)), axis=1)
        words[which, filled[which]] = (low[which] >> np.uint64(48)).astype(np.uint16)
        filled[which] += 1
        low[which] <<= _WORD

    for step in range(steps):
        n = int(running[step])
        models.begin(step, n)
        came = ids[step, :n]
        now = came.astype(np.int64)
        two_first, one_first, share, second_share = models.foretell(one[:n], two[:n])
        hit = two_first == now
        second = (one_first == now) & ~hit
        _narrow_flag(low, span, n, hit, second, share, second_share)
        known = hit | second
        models.learn(now, hit, second)
        for digit in range(digits):
            shift = 8 * (digits - 1 - digit)
            row = models.row(digit, now >> (shift + 8))
            symbol = (now >> shift) & 255
            start, length = models.interval(row, symbol)
            _narrow_digit(low, span, n, known, start, length)
            models.count(row, symbol)
            # The least span has room for the flag and two digits.
            if digit or digits == 1:
                _shift(low, span, n, put)
        two[:n], one[:n] = one[:n], came
    for _ in range(4):
        put(np.arange(lanes))
    coded: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order.tolist()):
        coded[i] = words[lane, : filled[lane]].astype("<u2").tobytes()
    return coded


def _narrow_flag(
    low: np.ndarray, span: np.ndarray, n: int, hit: np.ndarray, second: np.ndarray, share: np.ndarray, second_share: np.ndarray
) -> None:
    """Narrows to the part of the scale of the order that foretold the id: first order 2, then order 1, then order 0."""
    both = share + second_share
    start = np.where(hit, 0, np.where(second, share, both))
    length = np.where(hit, share, np.where(second, second_share, _FLAGS - both))
    part = span[:n] >> np.uint64(_FLAG_BITS)
    low[:n] += part * start.astype(np.uint64)
    np.multiply(part, length.astype(np.uint64), out=span[:n])


def _narrow_digit(low: np.ndarray, span: np.ndarray, n: int, known: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Narrows to a digit of order 0, where the id is not known already."""
    part = span[:n] >> np.uint64(_DIGIT_BITS)
    low[:n] += np.where(known, 0, part * start)
    span[:n] = np.where(known, span[:n], part * length)


def _shift(low: np.ndarray, span: np.ndarray, n: int, put) -> None:
    """Passes settled words on until every interval is wide again. Where an interval straddles a border it is cut there."""
    bottom, width = low[:n], span[:n]
    which = np.flatnonzero(((bottom ^ (bottom + width)) < _TOP) | (width < _BOTTOM))
    while len(which):
        bottom, width = low[which], span[which]
        settled = (bottom ^ (bottom + width)) < _TOP
        narrow = ~settled & (width < _BOTTOM)
        cut = which[narrow]
        span[cut] = (np.uint64(0) - low[cut]) & (_BOTTOM - np.uint64(1))
        which = which[settled | narrow]
        put(which)
        span[which] <<= _WORD


def decode(codes: list[bytes], lengths: list[int], digits: int) -> list[np.ndarray]:
    """The ids of each block, given its code and number of ids."""
    out: list[np.ndarray] = []
    for at in range(0, len(codes), LANES):
        out += _decode(codes[at : at + LANES], np.array(lengths[at : at + LANES], np.int64), _octets(digits))
    return out


def _decode(codes: list[bytes], lengths: np.ndarray, digits: int) -> list[np.ndarray]:
    order, running = _order_of(lengths)
    lanes, steps = len(codes), len(running)
    longest = max((len(c) // 2 for c in codes), default=0)
    words = np.zeros((lanes, longest + 4), np.uint16)
    for lane, i in enumerate(order.tolist()):
        own = np.frombuffer(codes[i], "<u2")
        words[lane, : len(own)] = own
    ids = np.zeros((steps, lanes), np.uint32)
    models = _Models(lanes, digits)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    code = np.zeros(lanes, np.uint64)
    for i in range(4):
        code = (code << _WORD) | words[:, i]
    read = np.full(lanes, 4, np.int64)
    one, two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def take(which: np.ndarray) -> None:
        code[which] = (code[which] << _WORD) | words[which, np.minimum(read[which], words.shape[1] - 1)]
        read[which] += 1
        low[which] <<= _WORD

    for step in range(steps):
        n = int(running[step])
        models.begin(step, n)
        two_first, one_first, share, second_share = models.foretell(one[:n], two[:n])
        aim = ((code[:n] - low[:n]) // (span[:n] >> np.uint64(_FLAG_BITS))).astype(np.int64)
        hit = aim < share
        second = ~hit & (aim < share + second_share)
        _narrow_flag(low, span, n, hit, second, share, second_share)
        known = hit | second
        foretold = np.where(hit, two_first, one_first)
        now = np.zeros(n, np.int64)
        for digit in range(digits):
            shift = 8 * (digits - 1 - digit)
            row = models.row(digit, now)
            aim = np.minimum((code[:n] - low[:n]) // (span[:n] >> np.uint64(_DIGIT_BITS)), np.uint64(_SCALE - 1))
            symbol = np.where(known, (foretold >> shift) & 255, models.find(row, aim.astype(np.uint16)))
            start, length = models.interval(row, symbol)
            _narrow_digit(low, span, n, known, start, length)
            models.count(row, symbol)
            now = (now << 8) | symbol
            if digit or digits == 1:
                _shift(low, span, n, take)
        models.learn(now, hit, second)
        ids[step, :n] = now
        two[:n], one[:n] = one[:n], ids[step, :n]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for lane, i in enumerate(order.tolist()):
        out[i] = ids[: lengths[i], lane].copy()
    return out
