"""Blocks of token ids, compressed by a range coder that mixes predictions of order 0 to 2.

A block of at most 1,024 ids lists its distinct ids, its alphabet, and how often each comes, and then codes the ids in turn. In the
sorted block an id takes as many slots as it comes times, and is known by the first of them. The chance of an id is a mixture of

* order 0: its part of the slots,
* order 1: the id that came last after the previous id,
* order 2: the id that came last after the previous two ids.

The weights of orders 1 and 2 belong to how often their predictions were right lately; the encoder fits them to the block, which
holds them: the part of the cases in which order 2 was right and, of the others, that in which order 1 was. Floats hold nothing but whole numbers below
2**53 and quotients of which only the whole part is taken, so every machine decodes what any machine encoded.

Every block starts from nothing and carries two checksums, so blocks are coded, read and verified independently. That makes
them lanes: numpy works on one id of many blocks at a time, and no Python loop runs per id of a block. Headers, alphabets and bits of
many blocks are taken apart and put together at once too. The encoder, which has all ids, finds what orders 1 and 2 expect by sorting.

Layout of a block, little endian: magic `FPTB`, version, three zero bytes, number of ids, size of the alphabet, number of code
words, CRC-32 of the ids as unsigned 32-bit numbers, CRC-32 of all before it and of all after it; then the alphabet as steps between
rising ids (a byte each, at most 255; then two bytes, at most 65,535, for those of 255 or more; then four for those of 65,535 or more), a bit for
each slot that is 1 where another id begins, four weights of order 2 and four of order 1 in a byte each, and code words of 16 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

BLOCK = 1024
LANES = 8192

_HEAD, _CHECK = "<4sB3xIIII", "<I"
_HEAD_SIZE, _BEGIN = struct.calcsize(_HEAD), struct.calcsize(_HEAD) + struct.calcsize(_CHECK)
_MAGIC, _VERSION = b"FPTB", 2
_SCALE = float(1 << 16)
_LIMIT = 1 << 12  # order 0 weighs at least as much of _SCALE, which is no less than the slots
_SLOTS = 10  # bits of a place in the tables of orders 1 and 2
_WEIGHTS = 8  # of order 2, then of order 1, by how often the prediction was right: never seen, 0, 1 and 2 or more times
_STEPS = 32  # ids of all lanes whose intervals are found at once
_ROWS = 128  # lanes that are prepared at once, few enough for a processor's cache
_TOP, _LOW = float(1 << 48), float(1 << 32)
_PART = 1 / _SCALE


class BrokenBlock(ValueError):
    """A block whose header, code words or ids do not agree with its checksums."""


class _Mixer:
    """The state of all lanes. Arrays with two rows hold order 1 in the first and order 2 in the second. Order 0 shares its weight
    among a power of two of slots."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray):
        lanes = len(counts)
        self.total = np.exp2(np.ceil(np.log2(np.maximum(counts, 1))))
        self.part = 1 / self.total
        free = _SCALE - _LIMIT
        second = np.repeat(np.floor(free * weights[:, :4] / 256), 4, 1)
        first = np.floor((free - second) * np.tile(weights[:, 4:], (1, 4)) / 256)
        # Both weights of a lane and how often its predictions were right (4 bits), in one number.
        self.weights = (first.astype(np.uint32) | second.astype(np.uint32) << 16).reshape(-1)
        self.states = np.arange(lanes) << 4

    def expect(self, found: np.ndarray) -> None:
        """Take in what both orders expect for the next id of the first lanes. `found` may hold several steps."""
        lanes = found.shape[-1]
        sure = found & 3
        self.foreseen = found >> 2
        self.guess = self.foreseen.astype(np.float64)
        pairs = self.weights.take(self.states[:lanes] + ((sure[1] << 2) + sure[0]))
        self.shares = np.empty(found.shape)
        self.shares[0], self.shares[1] = pairs & 0xFFFF, pairs >> 16
        self.both = self.shares[0] + self.shares[1]
        self.rest = _SCALE - self.both
        self.each = self.rest * self.part[:lanes]  # what a slot weighs; exact, as it is divided by a power of two

    def slot_at(self, value: np.ndarray) -> np.ndarray:
        """A slot of the id whose part of _SCALE holds the value: take the predictions' shares out, then find the slot."""
        edges = np.floor(self.guess * self.each)
        early = np.where(self.foreseen[0] > self.foreseen[1], self.shares[1], self.shares[0])
        value = np.minimum(value, np.maximum(value - early, np.minimum(edges[0], edges[1])))
        value = np.minimum(value, np.maximum(value - (self.both - early), np.maximum(edges[0], edges[1])))
        return (((value + 1) * self.total[: len(value)] - 1) / self.rest).astype(np.int64)

    def interval(self, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of the id's part of _SCALE."""
        slot = span & 0xFFFF
        begin, end = np.floor(slot * self.each), np.floor((span >> 16) * self.each)
        slot = slot.astype(np.int16)
        passed = self.shares * (slot > self.foreseen)
        reached = self.shares * (slot >= self.foreseen)
        begin += passed[0]
        begin += passed[1]
        end += reached[0]
        end += reached[1]
        return begin, end - begin


class _Past:
    """What came last after the last id (first row) and the last two ids (second row) of every lane."""

    def __init__(self, lanes: int):
        self.next = np.zeros(2 * lanes << _SLOTS, np.int16)  # first slot * 4 + how often it was right
        self.slots = (np.arange(2 * lanes) << _SLOTS).reshape(2, lanes)
        self.at = self.slots.copy()

    def found(self, active: int) -> np.ndarray:
        self.here = self.at[:, :active]
        self.last = self.next.take(self.here)
        return self.last

    def teach(self, slot: np.ndarray, two: np.ndarray) -> None:
        """Learn that the id with this first slot came. `two` mixes it with the one before."""
        own = slot.astype(np.int16) << 2
        off = self.last ^ own  # below 4 where the prediction was right
        off *= off < 4
        off -= off + 1 >> 2  # at most 2
        off += own
        off += 1
        self.next[self.here] = off
        active = len(slot)
        np.add(self.slots[0, :active], slot, out=self.at[0, :active])
        np.add(self.slots[1, :active], two, out=self.at[1, :active])


def _two(slot: np.ndarray, before: np.ndarray | int) -> np.ndarray:
    """The place of two ids in the table of order 2."""
    return before * 181 + slot * 67 & (1 << _SLOTS) - 1


def _expected(slots: np.ndarray) -> np.ndarray:
    """What both orders expect at each step of all lanes (rows): what `_Past` would find, without following it step by step. Steps after
    the end of a lane come last, so what is found before them does not depend on them."""
    lanes, width = slots.shape
    now = slots.astype(np.uint32)
    before = np.zeros((2, lanes, width), np.uint32)
    before[0, :, 1:], before[1, :, 2:] = now[:, :-1], now[:, :-2]
    now |= np.arange(width, dtype=np.uint32) << 10
    out = np.empty((2, lanes, width), np.int16)
    rows = (np.arange(lanes) * width)[:, None]
    for order, key in ((0, before[0]), (1, _two(before[0], before[1]))):
        key = key << 20 | now
        key.sort(1)
        place, slot = key >> 20, (key & 1023).astype(np.int16)
        same = place[:, 1:] == place[:, :-1]  # as the step before it in this place
        again = same & (slot[:, 1:] == slot[:, :-1])
        found = np.zeros((lanes, width), np.int16)
        sure = found[:, 1:]
        sure[:] = 1
        sure[:, 1:] += again[:, :-1]
        sure[:, 2:] += again[:, 1:-1] & again[:, :-2]
        sure |= slot[:, :-1] << 2
        sure *= same
        out[order].reshape(-1)[((key >> 10 & 1023) + rows).reshape(-1)] = found.reshape(-1)
    return out


def _fitted(found: np.ndarray, slots: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The weights of each lane, as bytes, from what both orders expected at each step and what came."""
    lanes = len(slots)
    cells = (np.arange(lanes) << 4)[:, None]
    counts, skipped = np.empty((2, lanes, 8)), ~inside
    for order in (1, 0):
        right = found[order] >> 2 == slots
        cell = cells + ((found[order] & 3) << 1 | right | skipped.view(np.int8) << 3)
        counts[order] = np.bincount(cell.reshape(-1), minlength=lanes << 4).reshape(lanes, 16)[:, :8]
        skipped |= right
    counts = counts.reshape(2, lanes, 4, 2)
    part = np.minimum(np.floor(256 * counts[..., 1] / np.maximum(counts.sum(-1), 1)), 255)
    return np.concatenate((part[1], part[0]), 1).astype(np.uint8)


def _runs(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flat places where another id begins or a lane does, and the number of slots of each."""
    heads = begins.copy()
    heads[:, 0] = True
    at = np.flatnonzero(heads)
    return at, np.diff(np.append(at, begins.size))


def _spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of all slots of all lanes, from a table that is true where another id begins."""
    lanes, width = begins.shape
    at, sizes = _runs(begins)
    lane, first = np.divmod(at, width)
    ends = np.minimum(first + sizes, lengths.take(lane))
    return np.repeat((first | ends << 16).astype(np.int32), sizes).reshape(lanes, width)


def _checked(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _active(lengths: np.ndarray) -> np.ndarray:
    """How many lanes, sorted by falling length, have an id at each step."""
    return np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")


def _pack_alphabets(known: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The coded form of alphabets put together, each ending at one of `ends`."""
    known = known.astype(np.int64)
    steps = np.diff(known, prepend=0)
    begins = np.append(0, ends[:-1])
    begins = begins[begins < ends]
    steps[begins] = known[begins]
    large = np.flatnonzero(steps >= 255)
    mid = steps[large]
    huge = np.flatnonzero(mid >= 65535)
    mids = np.searchsorted(large, ends)
    wides = np.searchsorted(huge, mids)
    coded = (
        np.minimum(steps, 255).astype(np.uint8).tobytes(),
        np.minimum(mid, 65535).astype("<u2").tobytes(),
        mid[huge].astype("<u4").tobytes(),
    )
    cuts = [np.append(0, size * to).tolist() for size, to in ((1, ends), (2, mids), (4, wides))]
    return [b"".join(data[at[k] : at[k + 1]] for data, at in zip(coded, cuts)) for k in range(len(ends))]


def _unpack_alphabets(blocks: Sequence[bytes], sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The alphabets of all blocks, put together, and where each ends in its block."""
    places, parts, counts = [_BEGIN] * len(blocks), [], sizes
    for top, kind in ((255, "<u1"), (65535, "<u2"), (None, "<u4")):
        stops = [at + n for at, n in zip(places, (counts * np.dtype(kind).itemsize).tolist())]
        parts.append(np.frombuffer(b"".join([b[at:to] for b, at, to in zip(blocks, places, stops)]), kind).astype(np.int64))
        places, ends = stops, np.cumsum(counts)
        if top:
            more = np.flatnonzero(parts[-1] == top)
            counts = np.diff(np.searchsorted(more, ends), prepend=0)
    steps, mid, wide = parts
    mid[mid == 65535] = wide
    steps[steps == 255] = mid
    known = np.append(0, np.cumsum(steps))
    ends = np.cumsum(sizes)
    return (known[1:] - np.repeat(known.take(ends - sizes), sizes)).astype(np.uint32), places


def encode_blocks(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """The coded form of each block of at most BLOCK ids below 2**32."""
    if any(len(b) > BLOCK for b in blocks):
        raise ValueError(f"a block has more than {BLOCK} ids")
    out: list[bytes] = []
    for at in range(0, len(blocks), LANES):
        out += _encode_lanes(blocks[at : at + LANES])
    return out


def _prepared(
    blocks: Sequence[np.ndarray], lengths: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """The spans of the ids of some lanes, what both orders expect and the weights; sizes of the alphabets, their coded form, and the slots' bits."""
    lanes = len(blocks)
    # An id and its time make one number; sorted, they give the slots.
    timed = np.zeros((lanes, width), np.uint32)
    for lane, block in enumerate(blocks):
        timed[lane, : len(block)] = block
    kind = np.uint64 if timed.max() >= 1 << 22 else np.uint32
    timed = timed.astype(kind, copy=False)
    timed <<= kind(10)
    timed |= np.arange(width, dtype=kind)
    inside = np.arange(width) < lengths[:, None]
    if lengths[-1] < width:
        timed[~inside] = np.iinfo(kind).max
    timed.sort(1)
    known = timed >> kind(10)
    begins = np.ones((lanes, width), np.bool_)
    np.not_equal(known[:, 1:], known[:, :-1], out=begins[:, 1:])
    begins &= inside
    spans = _spans(begins, lengths)
    # Lanes without an id at a time have their places among those after the last id.
    when = (timed & kind(1023)).astype(np.int64)
    if lengths[-1] < width:
        when = np.where(inside, when, np.arange(width))
    when += (np.arange(lanes) * width)[:, None]
    turns = np.empty((lanes, width), np.int32)  # the span of each id, in the order of time
    turns.reshape(-1)[when.reshape(-1)] = spans.reshape(-1)
    slots = (turns & 0xFFFF).astype(np.int16)
    found = _expected(slots)
    sizes = np.count_nonzero(begins, 1)
    alphabets = _pack_alphabets(known[begins], np.cumsum(sizes))
    return turns, found, _fitted(found, slots, inside), sizes, alphabets, np.packbits(begins, 1)


def _encode_lanes(blocks: Sequence[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    lanes, longest = len(order), int(lengths[0])
    width = max(longest, 1)
    turns, found = np.empty((width, lanes), np.int32), np.empty((2, width, lanes), np.int16)
    weights, sizes, alphabets, bits = np.empty((lanes, _WEIGHTS), np.uint8), np.empty(lanes, np.int64), [], []
    for at in range(0, lanes, _ROWS):
        part = slice(at, at + _ROWS)
        own, expected, weights[part], sizes[part], known, slots = _prepared([blocks[i] for i in order[part]], lengths[part], width)
        turns[:, part], found[:, :, part] = own.T, expected.swapaxes(1, 2)
        alphabets += known
        bits.append(slots.tobytes())
    bits = b"".join(bits)
    mixer = _Mixer(lengths, weights)
    room = longest + 4
    words = np.zeros(lanes * room, np.uint32)
    start = np.arange(lanes) * room
    place, low, span = start.copy(), np.zeros(lanes), np.full(lanes, _TOP)
    for t, n in enumerate(_active(lengths)):
        if t % _STEPS == 0:
            mixer.expect(found[:, t : t + _STEPS])
            begin, length = mixer.interval(turns[t : t + _STEPS])
        unit = np.floor(span[:n] * _PART)
        now, left = low[:n] + unit * begin[t % _STEPS, :n], unit * length[t % _STEPS, :n]
        carry = np.flatnonzero(now >= _TOP)
        if len(carry):
            words[place[carry] - 1] += 1
            now[carry] -= _TOP
        full = np.flatnonzero(left < _LOW)
        spill = now[full]
        high = np.floor(spill / _LOW)
        words[place[full]] = high
        place[full] += 1
        now[full] = (spill - high * _LOW) * _SCALE
        left[full] *= _SCALE
        low[:n], span[:n] = now, left
    for shift in (32, 16, 0):
        words[place] = low.astype(np.int64) >> shift & 0xFFFF
        place += 1
    over = np.flatnonzero(words >> 16)
    while len(over):  # carries that were left in their words
        words[over - 1] += words[over] >> 16
        words[over] &= 0xFFFF
        over = over[words[over - 1] >> 16 > 0] - 1
    own, code, wide = weights.tobytes(), words.astype("<u2").tobytes(), (width + 7) // 8
    out: list[bytes] = [b""] * lanes
    each = zip(order, lengths.tolist(), sizes.tolist(), (place - start).tolist(), alphabets)
    for lane, (i, count, size, coded, alphabet) in enumerate(each):
        rest = b"".join((
            alphabet,
            bits[lane * wide : lane * wide + (count + 7) // 8],
            own[lane * _WEIGHTS : (lane + 1) * _WEIGHTS],
            code[2 * lane * room : 2 * (lane * room + coded)],
        ))
        head = struct.pack(_HEAD, _MAGIC, _VERSION, count, size, coded, _checked(blocks[i]))
        out[i] = head + struct.pack(_CHECK, zlib.crc32(rest, zlib.crc32(head))) + rest
    return out


def _open(block: bytes) -> tuple[int, int, int, int]:
    """Number of ids, size of the alphabet, number of code words and the ids' checksum."""
    if len(block) < _BEGIN:
        raise BrokenBlock("a block is shorter than its header")
    magic, version, count, known, size, check = struct.unpack_from(_HEAD, block)
    if magic != _MAGIC or version != _VERSION:
        raise BrokenBlock("not a block of token ids")
    if zlib.crc32(block[_BEGIN:], zlib.crc32(block[:_HEAD_SIZE])) != struct.unpack_from(_CHECK, block, _HEAD_SIZE)[0]:
        raise BrokenBlock("a block does not agree with its checksum")
    return count, known, size, check


def decode_blocks(blocks: Sequence[bytes]) -> list[np.ndarray]:
    """The ids of each coded block; raises BrokenBlock if a checksum does not agree."""
    out: list[np.ndarray] = []
    for at in range(0, len(blocks), LANES):
        out += _decode_lanes(blocks[at : at + LANES])
    return out


def _decode_lanes(blocks: Sequence[bytes]) -> list[np.ndarray]:
    opened = [_open(b) for b in blocks]
    order = sorted(range(len(opened)), key=lambda i: -opened[i][0])
    blocks = [blocks[i] for i in order]
    lengths, sizes, coded, _ = np.array([opened[i] for i in order], np.int64).T
    lanes, longest = len(order), int(lengths[0])
    room, width = int(coded.max()) + 4, max(longest, 1)
    alphabets, places = _unpack_alphabets(blocks, sizes)
    wide = (width + 7) // 8
    bits, own, words = [], [], []
    for block, at, count, size in zip(blocks, places, lengths.tolist(), coded.tolist()):
        to = at + (count + 7) // 8
        bits.append(block[at:to].ljust(wide, b"\0"))
        own.append(block[to : to + _WEIGHTS])
        to += _WEIGHTS
        words.append(block[to : to + 2 * size].ljust(2 * room, b"\0"))
    words = np.frombuffer(b"".join(words), "<u2").reshape(lanes, room)
    weights = np.frombuffer(b"".join(own), np.uint8).reshape(lanes, _WEIGHTS)
    bits = np.frombuffer(b"".join(bits), np.uint8).reshape(lanes, wide)
    begins = np.unpackbits(bits, axis=1, count=width).view(np.bool_)
    if (np.count_nonzero(begins, 1) != sizes).any():
        raise BrokenBlock("a block's alphabet does not agree with its slots")
    code = (words[:, 0] * _LOW + words[:, 1] * _SCALE) + words[:, 2]
    words = words.reshape(-1)
    place, span = np.arange(lanes) * room + 3, np.full(lanes, _TOP)
    spans = np.empty((lanes, width), np.int32)
    for at in range(0, lanes, _ROWS):
        spans[at : at + _ROWS] = _spans(begins[at : at + _ROWS], lengths[at : at + _ROWS])
    spans = spans.reshape(-1)
    base = np.arange(lanes) * width
    past, mixer = _Past(lanes), _Mixer(lengths, weights)
    turns = np.zeros((longest, lanes), np.int16)
    before: np.ndarray | int = 0
    for t, n in enumerate(_active(lengths)):
        mixer.expect(past.found(n))
        unit = np.floor(span[:n] * _PART)
        slot = mixer.slot_at(np.minimum(np.floor(code[:n] / unit), _SCALE - 1))
        slot += base[:n]
        own = spans.take(slot)
        begin, length = mixer.interval(own)
        now, left = code[:n] - unit * begin, unit * length
        # Lanes that are short take in a word; the others are multiplied by 1 and get 0.
        short = left < _LOW
        at = place[:n]
        more = short * (_SCALE - 1)
        more += 1
        np.multiply(now, more, out=now)
        np.multiply(left, more, out=span[:n])
        np.add(now, words.take(at) * short, out=code[:n])
        at += short
        own &= 0xFFFF
        turns[t, :n] = own
        own = own.astype(np.int64)
        past.teach(own, _two(own, before if t == 0 else before[:n]))
        before = own
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * lanes
    ends = np.append(0, np.cumsum(sizes))
    for at in range(0, lanes, _ROWS):
        if not lengths[at]:  # nor have the lanes after it
            break
        part = slice(at, min(at + _ROWS, lanes))
        heads, counts = _runs(begins[part])
        # A lane without ids has a place, but no id in the alphabet.
        which = np.cumsum(begins[part].reshape(-1).take(heads)) - 1
        ids = np.repeat(alphabets[ends[at] : ends[part.stop]].take(np.maximum(which, 0)), counts)
        ids = ids.take(turns[:, part].T + base[: part.stop - at, None])
        for own, i, count in zip(ids, order[part], lengths[part].tolist()):
            out[i] = own[:count]
    for i, own in enumerate(out):
        if _checked(own) != opened[i][3]:
            raise BrokenBlock("the ids of a block do not agree with their checksum")
    return out
