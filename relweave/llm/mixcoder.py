"""An adaptive context-mixing range coder for token ids, in independent blocks.

Every block starts from an empty model and is coded alone, so many blocks are coded side by side:
one step codes one id of each block (lane). Three orders predict the next id:

* order 2 and order 1: tables of the id that last followed the last two ids (the last id), each with
  a small count of how often it was right in a row;
* order 0: adaptive counts of the ids' magnitude class (exponent and next three bits).

An id is an order-2 hit, an order-1 hit, or a literal. The chance of an order-2 hit is mixed from
adaptive rates of all three orders by weights that learn as they go (logistic mixing in integers, so
that every machine decodes alike); the rest of the coding range goes to order 1 and to the classes.
The tables learn from every id; rates, weights and counts learn from all ids of a window at its end, so that
within a window the parts of the range are looked up by what the tables say. The low bits of a literal
are equally likely; they follow the coded words as they are.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK = 2_048
_SLOTS1, _SLOTS2 = 512, 1_024
_TOP, _LOW = 48, 32  # the coding range stays between 2**32 and 2**48; words have 16 bits
_CODE = (1 << _TOP) - 1
_TOTAL = 4_096  # of the class counts
_LEAST = 8  # of any class
_SPANS = _TOTAL // _LEAST  # spans of that width hold at most one end of a class
_WINDOW = 128
_PIECE = 32  # steps whose arrays are worked on at once, so that they stay near the processor
_RATE = 13  # shift of what the weights learn

_squash = np.array([round(4096 / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], np.int32).clip(32, 3968)
_stretch = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int32).clip(-2047, 2047)
_right = np.array([1, 2, 3, 3, 0], np.uint32)  # how often an id was right, after 0 to 3 times and another hit, or a miss
_keys = (np.array([[4], [3]], np.uint32), np.array([[_SLOTS1 - 1], [_SLOTS2 - 1]], np.uint32))


def _class_count(bits: int) -> int:
    return 16 + max(0, bits - 4) * 8


def _windows(steps: int) -> list[tuple[int, int]]:
    """First and last step of each window; the first ones are short."""
    ends = [t for t in (8, 16, 32, 64) if t < steps] + list(range(_WINDOW, steps, _WINDOW)) + [steps]
    return list(zip([0, *ends], ends))


class _Model:
    """Predictions for all lanes; ``renew`` after each window.

    A word of a table is an id and, in its two low bits, how often it was right. A cell is what both tables
    say: how sure order 2 and order 1 are, and whether they name the same id."""

    def __init__(self, lanes: int, bits: int):
        lane = np.arange(lanes)
        slots = _SLOTS1 + _SLOTS2
        self.lanes, self.lane, self.base = lanes, lane, np.stack([lane * slots, lane * slots + _SLOTS1])
        self.table = np.zeros(lanes * slots, np.uint32)
        self.wide = -(-lanes // 8) * 8
        self.tries = np.zeros((3, 4, 4, 2, lanes), np.int32)  # what came (literal, order 1, order 2) by cell
        self.weights = np.repeat(np.array([[13_000], [36_000], [16_000]], np.int32), lanes, 1)
        self.classes = _class_count(bits)
        self.counts = np.full((self.classes, lanes), 2, np.int32)
        self.ends = np.zeros((self.classes + 1, lanes), np.int32)
        self._intervals()

    def keys(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Places in the tables of order 1 and order 2, modulo 2**32 before the low bits are used."""
        both = np.empty((*last.shape[:-1], 2, self.lanes), np.uint32)
        one, two = both[..., 0, :], both[..., 1, :]
        np.multiply(last, np.uint32(40_503), out=one)
        np.multiply(before, np.uint32(30_011), out=two)
        two += one
        both >>= _keys[0]
        both &= _keys[1]
        return both + self.base

    def cells(self, words: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Places of the cells among all lanes' cells."""
        sure = words & 3
        at = sure[..., 1, :] << 2
        at += sure[..., 0, :]
        at <<= 1
        at += same
        return at * np.int64(self.lanes) + self.lane

    def note(self, words: np.ndarray, at: np.ndarray, entry: np.ndarray) -> None:
        """Both tables learn the id that came."""
        change = words - entry
        np.minimum(change, 4, out=change)
        change = _right.take(change, mode="clip")
        change += entry
        self.table[at] = change

    def renew(self, cells: np.ndarray, came: np.ndarray, kinds: np.ndarray) -> None:
        """Learn from the cells of a window, what came in them, and the classes of the literals.

        ``kinds`` are the places of these classes among all lanes' classes."""
        found = np.bincount((came * np.int64(32 * self.lanes) + cells).ravel(), minlength=self.tries.size)
        found = found.astype(np.int32).reshape(self.tries.shape)
        self.tries += found
        error = (found[2] << 12) - found.sum(0, dtype=np.int32) * self.mixed
        for w, x in zip(self.weights, self.inputs):
            w += ((x * error.astype(np.float64)).sum((0, 1, 2)) // (1 << _RATE)).astype(np.int32)  # exact in 53 bits
        np.clip(self.weights, -65_536, 131_072, out=self.weights)
        seen = np.bincount(kinds, minlength=self.counts.size).astype(np.int32).reshape(self.counts.shape)
        seen *= 12
        self.counts += seen
        self._intervals()

    def _intervals(self) -> None:
        """The ends of the parts of the 16-bit range, by cell, and of the classes' parts of theirs."""
        literal, one, two = self.tries
        n = literal + one + two
        rate0 = _rate(two.sum((0, 1, 2)), n.sum((0, 1, 2)), 2)
        rate2 = _rate(two.sum((1, 2)), n.sum((1, 2)), 1)[:, None, None]
        rate1 = _rate(one.sum((0, 2)) + two[:, :, 1].sum(0), n.sum((0, 2)), 1)[:, None]
        left = _rate(one[:, :, 0].sum(0), (n - two)[:, :, 0].sum(0), 1).clip(16, 3_072).astype(np.int32)
        sign = np.array([[-1], [1]], np.int32)
        self.inputs = [_stretch[rate0], _stretch[rate2], _stretch[rate1] * sign]
        dot = sum(w * x for w, x in zip(self.weights, self.inputs)) >> 16
        self.mixed = _squash.take(dot + 2047, mode="clip")
        end2 = self.mixed << 4
        end1 = end2.copy()
        end1[:, :, 0] += (65_536 - end2[:, :, 0]) * left >> 12
        self.end2, self.end1 = end2.ravel().astype(np.int64), end1.ravel().astype(np.int64)
        share = self.counts * np.int32(_TOTAL - _LEAST * self.classes)
        share //= self.counts.sum(0, dtype=np.int32)
        share += _LEAST
        np.cumsum(share, 0, out=self.ends[1:])
        self.ends[-1] = _TOTAL
        self.flat, self.spans = self.ends.ravel().astype(np.int64), None

    def literal(self, at: np.ndarray, end1: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of the range of literals of the classes at these places of the ends."""
        start, end = self.flat.take(at, mode="clip"), self.flat.take(at + self.lanes, mode="clip")
        for side in (start, end):
            side *= mass
            side >>= 12
            side += end1
        return start, end

    def find(self, value: np.ndarray, end1: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class whose part of the range holds the value (the last start that is not above it) and its place."""
        if self.spans is None:
            marks = np.zeros((_SPANS, self.wide), np.uint8)
            marks[(self.ends[1:-1] + (_LEAST - 1)) // _LEAST, self.lane] = 1
            eight = marks.view(np.uint64)  # lanes at once, none of which counts to 256
            self.spans = np.cumsum(eight, 0, out=eight).view(np.uint8).ravel()
        target = value - end1
        target <<= 12
        target += _TOTAL - 1
        target = (target / mass).astype(np.int64)  # exact, both are short
        place = target >> 3
        place *= self.wide
        place += self.lane
        kind = self.spans.take(place, mode="clip").astype(np.int64)
        place = kind * self.lanes
        place += self.lane
        more = (self.flat.take(place + self.lanes, mode="clip") <= target).astype(np.int64)
        kind += more
        more *= self.lanes
        place += more
        return kind, place


def _rate(hits: np.ndarray, tries: np.ndarray, first: int) -> np.ndarray:
    return (hits + first) * 4095 // (tries + 16)


def _join(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First id of each class and its number of low bits."""
    low = np.where(kind < 16, 0, (kind - 16) // 8 + 1)
    return np.where(kind < 16, kind, (8 + (kind & 7)) << low), low


def _lanes(n: int) -> tuple[np.ndarray, int]:
    """Lengths of the blocks of n ids; all but the last are full."""
    blocks = -(-n // BLOCK)
    size = np.full(blocks, BLOCK)
    if n:
        size[-1] = n - BLOCK * (blocks - 1)
    return size, blocks


def _pack(bits: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of each block one after the other in 32-bit words, and how many words each takes."""
    ends = np.cumsum(bits, 1, dtype=np.int64)
    words = (ends[:, -1] + 31) >> 5
    ends -= bits
    ends += ((np.cumsum(words) - words) << 5)[:, None]
    at, moved = ends.ravel(), (values & ((np.uint32(1) << bits.view(np.uint32)) - np.uint32(1))).ravel().astype(np.uint64)
    moved <<= (at & 31).view(np.uint64)
    at >>= 5
    out = np.zeros(int(words.sum()) + 2, np.uint64)
    np.add.at(out, at, moved & np.uint64(0xFFFFFFFF))  # no two share a bit
    moved >>= np.uint64(32)
    np.add.at(out, at + 1, moved)
    return out[:-2].astype("<u4"), words


def _kinds(ids: np.ndarray) -> np.ndarray:
    """The class of each id."""
    shift = np.maximum(np.frexp(ids.astype(np.float32))[1] - 4, 0)  # exact below 2**24
    kind = (ids >> shift.astype(np.uint32)).astype(np.int32)
    kind += shift << 3
    return kind


def encode(ids: np.ndarray, bits: int) -> tuple[bytes, bytes, bytes]:
    """(payload, numbers of coded and of low words of each block, crc32 of each block) of ids below 2**bits."""
    size, blocks = _lanes(len(ids))
    if not blocks:
        return b"", b"", b""
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(blocks, BLOCK)
    last = int(size[-1])
    wide = BLOCK + 8
    model, low, rng = _Model(blocks, bits), np.zeros(blocks, np.int64), np.full(blocks, 1 << _TOP)
    widths = _join(np.arange(model.classes))[1].astype(np.int32)
    out, put = np.zeros(blocks * wide, np.uint32), np.arange(blocks) * wide
    first = put.copy()
    lows = np.zeros((blocks, BLOCK), np.int32)
    before = np.zeros((2, blocks), np.uint32)
    for window in _windows(int(size.max())):
        noted = []
        for t0 in range(*window, _PIECE):
            t1 = min(t0 + _PIECE, window[1])
            x = np.ascontiguousarray(grid[:, t0:t1].T)
            known = np.concatenate([before, x])
            before = known[-2:]
            places, entries = model.keys(known[1:-1], known[:-2]), x << 2
            words = np.empty(places.shape, np.uint32)
            for at, word, entry in zip(places, words, entries):
                model.table.take(at, out=word, mode="clip")
                model.note(word, at, entry)
            hits = words >> 2
            cells = model.cells(words, hits[:, 0] == hits[:, 1])
            end2, end1 = model.end2.take(cells, mode="clip"), model.end1.take(cells, mode="clip")
            two, one = x == hits[:, 1], x == hits[:, 0]
            one &= ~two
            lit = ~(two | one)
            kind = _kinds(x)
            lows[:, t0:t1] = (widths.take(kind, mode="clip") * lit).T
            kinds = kind * np.int64(blocks) + model.lane
            start, width = model.literal(kinds, end1, 65_536 - end1)
            start = np.where(two, 0, np.where(one, end2, start))
            width = np.where(two, end2, np.where(one, end1, width))
            width -= start
            for t, (a, w) in enumerate(zip(start, width), t0):
                part = rng >> 16
                if t >= last:  # only the last block may be short; its lane idles from here
                    a[-1], w[-1], part[-1] = 0, 1, rng[-1]
                low += part * a
                np.multiply(part, w, out=rng)
                if low.max() > _CODE:  # carries; what they make of the words before is settled at the end
                    over = np.flatnonzero(low > _CODE)
                    out[put[over] - 1] += 1
                    low &= _CODE
                out[put] = low >> _LOW
                small = rng - (1 << _LOW)
                small >>= 63  # all bits where the range has become small
                put -= small
                small &= 16
                rng <<= small
                low <<= small
                low &= _CODE
            if t1 > last:
                lit[max(last - t0, 0) :, -1] = False
                lows[-1, last:] = 0
            came = two * np.uint8(2)
            came += one
            noted.append((cells, came, kinds[lit]))
        model.renew(*map(np.concatenate, zip(*noted)))
    for shift in (32, 16, 0):
        out[put] = (low >> shift) & 0xFFFF
        put += 1
    while (over := np.flatnonzero(out > 0xFFFF)).size:
        out[over] -= 1 << 16
        out[over - 1] += 1
    counts = put - first
    coded = out.astype("<u2").reshape(blocks, wide)
    packed = [_pack(lows[i : i + _PIECE], grid[i : i + _PIECE]) for i in range(0, blocks, _PIECE)]
    raw, raws = map(np.concatenate, zip(*packed))
    payload = b"".join(coded[i, :n].tobytes() for i, n in enumerate(counts)) + raw.tobytes()
    sums = [zlib.crc32(grid[i, :n].astype("<u4", copy=False)) for i, n in enumerate(size)]
    return payload, np.concatenate([counts, raws]).astype("<u4").tobytes(), np.array(sums, "<u4").tobytes()


def decode(payload: bytes, words: bytes, sums: bytes, n: int, bits: int) -> np.ndarray:
    """The n ids; raises ValueError if a block does not have its checksum."""
    size, blocks = _lanes(n)
    counts = np.frombuffer(words, "<u4").astype(np.int64)
    counts, raws = counts[:blocks], counts[blocks:]
    if len(raws) != blocks or len(payload) != 2 * counts.sum() + 4 * raws.sum():
        raise ValueError("a token segment is damaged: its length is wrong")
    if not blocks:
        return np.zeros(0, np.int64)
    split = 2 * int(counts.sum())
    data = np.concatenate([np.frombuffer(payload[:split], "<u2"), np.zeros(8, np.uint16)]).astype(np.int64)
    raw = np.concatenate([np.frombuffer(payload[split:], "<u4"), np.zeros(2, np.uint32)]).astype(np.uint64)
    raw = raw[:-1] | raw[1:] << np.uint64(32)  # 64 bits from any word on
    at, bit = np.cumsum(counts) - counts, (np.cumsum(raws) - raws) << 5
    code = sum(data[at + i] << s for i, s in enumerate((32, 16, 0)))
    at += 2  # the last word read
    model, rng, last, left = _Model(blocks, bits), np.full(blocks, 1 << _TOP), int(size[-1]), 0
    bases, widths = _join(np.arange(model.classes))
    bases, masks = bases.astype(np.uint32), ((1 << widths) - 1).astype(np.uint64)
    grid = np.zeros((BLOCK, blocks), np.uint32)
    x = before = np.zeros(blocks, np.uint32)
    # of a literal, order 1 and order 2
    starts, ends, ids = (np.zeros((3, blocks), kind) for kind in (np.int64, np.int64, np.uint32))
    for t0, t1 in _windows(int(size.max())):
        cells = np.empty((t1 - t0, blocks), np.int64)
        came, kinds = np.empty(cells.shape, np.uint8), []
        for t in range(t0, t1):
            places = model.keys(x, before)
            before, x = x, grid[t]
            found = model.table.take(places, mode="clip")
            named = np.right_shift(found, 2, out=ids[1:])
            cell = cells[t - t0] = model.cells(found, named[0] == named[1])
            end2, end1 = model.end2.take(cell, mode="clip"), model.end1.take(cell, mode="clip")
            if t == last:
                left = int(code[-1])  # of the last block, which may be short
            part = rng >> 16
            value = (code / part).astype(np.int64)
            np.minimum(value, 65_535, out=value)
            two, hit = value < end2, value < end1
            mass = 65_536 - end1
            kind, place = model.find(value, end1, mass)
            what = np.add(two, hit, dtype=np.int64)
            came[t - t0] = what
            what *= blocks
            what += model.lane
            starts[0], ends[0] = model.literal(place, end1, mass)
            starts[1], ends[1], ends[2] = end2, end1, end2
            start, end = starts.take(what), ends.take(what)
            end -= start
            code -= part * start
            np.multiply(part, end, out=rng)
            rest = raw.take(bit >> 5, mode="clip")
            rest >>= (bit & 31).view(np.uint64)
            rest &= masks.take(kind, mode="clip")
            lit = ~hit
            bit += widths.take(kind, mode="clip") * lit
            ids[0] = rest
            ids[0] += bases.take(kind, mode="clip")
            ids.take(what, out=x, mode="clip")
            if t >= last:
                code[-1], rng[-1], lit[-1] = 0, 1 << _TOP, False
            small = rng - (1 << _LOW)
            small >>= 63  # all bits where the range has become small
            at -= small
            word = data.take(at, mode="clip")
            word &= small
            small &= 16
            rng <<= small
            code <<= small
            code |= word
            model.note(found, places, x << 2)
            kinds.append(place[lit])
        model.renew(cells, came, np.concatenate(kinds))
    if left or code.any():
        raise ValueError("a token segment is damaged: the coded words do not end where they should")
    rows = np.ascontiguousarray(grid.T).astype("<u4", copy=False)
    for i, (length, want) in enumerate(zip(size, np.frombuffer(sums, "<u4"), strict=True)):
        if zlib.crc32(rows[i, :length]) != want:
            raise ValueError(f"a token segment is damaged: block {i} does not have its checksum")
    return rows.ravel()[:n]
