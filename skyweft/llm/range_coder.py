"""Adaptive context-mixing range coder for token ids, in independently reset and checksummed blocks.

A block of up to BLOCK ids is numbered by its own sorted alphabet and laid out as lanes of consecutive ids.
All lanes advance together by one id a step, each with a range coder of its own, and share the block's model,
which starts afresh with the block and learns after each step what the lanes coded in it.

Orders 2 and 1 each predict one id from the hashed last two ids or the last id, with a confidence of 0 to 3; order 0
gives every id its adaptive count's share, renewed at steps 1, 2, 4, ... and then every RENEW steps. The three
distributions are mixed: an id's span is the sum of what each gives it, with weights of 12 bits that are adapted for
each pair of confidences to how often either order is right. Order-0 shares take 18 bits. The two guesses lie
before all other ids, each with its whole mixture, so each id has one span of a range that is at least 2**32 before it,
and one word of 32 bits widens the range again. The encoder's low end is of 64 bits; a carry is added to the word before.

Block: "CMR3", ids, alphabet size, lanes, crc32 of the ids (uint32 each), words a lane (uint16), alphabet
(uint16), words of lane after lane (uint32), crc32 of all before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1 << 21
LANE = 512
MAGIC = b"CMR3"
HASHED = 1 << 16
RENEW = 32
FLAG_BITS, SPAN_BITS = 12, 18
#: What an entry changes by, at confidence * 2 + whether it was wrong.
STEPS = np.array([1, -1, 1, -1, 1, -1, 0, -1], np.int64)
SHIFT, WIDE, LOW = np.uint64(32), np.uint64(1 << 32), np.uint64((1 << 32) - 1)


class _Model:
    """Order-2, order-1 and order-0 state of a block. Ids are numbers within the block's alphabet.

    An entry holds a prediction and its confidence: id * 4 + confidence. Entries of one id differ in two bits only.
    """

    def __init__(self, letters: int, lanes: int):
        self.first, self.second = np.zeros(letters, np.int64), np.zeros(HASHED, np.int64)
        self.flags = np.tile(np.array([2, 2, 4], np.int64), (16, 1))
        self.counts = np.ones(letters, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step, self.escaped, self.coded = 0, [], []
        self.spans()
        self.chances()

    def spans(self) -> None:
        """Order-0 spans of all ids within 2**SPAN_BITS, at least one each; the commonest id takes the rest."""
        if self.escaped:
            self.counts += 32 * np.bincount(np.concatenate(self.escaped), minlength=len(self.counts))
        self.escaped = []
        width = (1 << SPAN_BITS) - len(self.counts)
        own = 1 + self.counts * width // self.counts.sum()
        own[self.counts.argmax()] += (1 << SPAN_BITS) - own.sum()
        self.shares = own.astype(np.uint64) << SHIFT | (np.cumsum(own) - own).astype(np.uint64)
        self.holder = np.repeat(np.arange(len(own)).astype(np.uint16), own)

    def chances(self) -> None:
        """Weights of orders 2, 1 and 0 in each context, 2**FLAG_BITS together, from how often order 2 was right, else order 1, or neither."""
        if self.coded:
            self.flags += 2 * np.bincount(np.concatenate(self.coded), minlength=64).reshape(16, 4)[:, :3]
        self.coded = []
        rest = (1 << FLAG_BITS) - 3
        own = 1 + self.flags * rest // self.flags.sum(axis=1, keepdims=True)
        own[:, 2] += (1 << FLAG_BITS) - own.sum(axis=1)
        # four entries a context, so that context * 4 + flag finds them
        self.flag_own = np.zeros(64, np.uint64)
        self.flag_own.reshape(16, 4)[:, :3] = own
        self.mass = self.flag_own << np.uint64(SPAN_BITS)

    def predict(self) -> np.ndarray:
        """The place of each lane's context in the tables of weights."""
        self.slot = (self.before * 40503 + self.last) & (HASHED - 1)
        self.held1, self.held2 = self.first[self.last], self.second[self.slot]
        self.sure1, self.sure2 = self.held1 & 3, self.held2 & 3
        return (self.sure2 << 4) + (self.sure1 << 2)

    def mixture(self, context: np.ndarray) -> None:
        """Both guesses of each lane with all that the mixture gives them, and the weight of order 0."""
        self.guess2, self.guess1 = self.held2 >> 2, self.held1 >> 2
        self.rest, alike = self.flag_own[context + 2], self.guess1 == self.guess2
        mass1 = self.mass[context + 1]
        self.own2, self.own1 = self.shares[self.guess2] >> SHIFT, (self.shares[self.guess1] >> SHIFT) * ~alike
        self.all2 = self.mass[context] + self.rest * self.own2 + mass1 * alike
        self.all1 = mass1 * ~alike + self.rest * self.own1

    def others(self, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ids that are no guess of their lanes: order 0 without the guesses, behind them."""
        own, below = self.span(ids)
        before = below - self.own2[at] * (self.guess2[at] < ids) - self.own1[at] * (self.guess1[at] < ids)
        rest = self.rest[at]
        return self.all2[at] + self.all1[at] + rest * before, rest * own

    def other(self, at: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The ids at places behind both guesses."""
        guess2, guess1, own2, own1 = self.guess2[at], self.guess1[at], self.own2[at], self.own1[at]
        place = ((point - self.all2[at] - self.all1[at]).view(np.int64) / self.rest[at].view(np.int64)).astype(np.int64).view(np.uint64)
        # where either guess's share was taken out, in places without the other's
        gap2 = (self.shares[guess2] & LOW) - own1 * (guess1 < guess2)
        gap1 = (self.shares[guess1] & LOW) - own2 * (guess2 < guess1)
        place = place + own2 * (place >= gap2) + own1 * (place >= gap1)
        return self.holder[place.view(np.int64)].astype(np.int64)

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order-0 share, shares of the ids before it) of each id."""
        both = self.shares[ids]
        return both >> SHIFT, both & LOW

    def learn(self, ids: np.ndarray, entry: np.ndarray, flag: np.ndarray, escaped: np.ndarray, wrong2: np.ndarray, wrong1: np.ndarray) -> None:
        """Take in what all lanes coded in this step. Lanes that share a slot: the last one's entry stays."""
        for table, slot, held, sure, wrong in ((self.first, self.last, self.held1, self.sure1, wrong1), (self.second, self.slot, self.held2, self.sure2, wrong2)):
            at = (sure << 1) + wrong
            # right: surer; wrong: less sure, and replaced where it wasn't sure at all
            table[slot] = np.where(at == 1, entry, held + STEPS[at])
        self.escaped.append(escaped)
        self.step += 1
        young = self.step <= RENEW
        if young or self.step % 4 == 0:  # later, every fourth step tells enough of the chances
            self.coded.append(flag)
            if young or self.step % 16 == 0:
                self.chances()
        if self.step % RENEW == 0 or (young and self.step & (self.step - 1) == 0):
            self.spans()
        self.before, self.last = self.last, ids


def _encoded(block: np.ndarray) -> bytes:
    present = np.bincount(block, minlength=1 << 16) > 0
    letters = np.flatnonzero(present)
    lanes = -(-len(block) // LANE)
    steps = -(-len(block) // lanes)
    ids = np.zeros(lanes * steps, np.int64)
    ids[: len(block)] = (np.cumsum(present) - 1)[block]
    ids = np.ascontiguousarray(ids.reshape(lanes, steps).T)
    model = _Model(len(letters), lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words = np.zeros((lanes, steps + 2), np.uint64)  # a lane's word 0 takes no carry
    flat, first = words.reshape(-1), np.arange(lanes) * (steps + 2)
    spot = first + 1
    for now in ids:
        context = model.predict()
        entry = now << 2
        wrong2, wrong1 = (model.held2 ^ entry) > 3, (model.held1 ^ entry) > 3
        neither = wrong2 & wrong1
        flag = context + wrong2 + neither
        model.mixture(context)
        start, size = model.all2 * wrong2, np.where(wrong2, model.all1, model.all2)
        at = np.flatnonzero(neither)
        escaped = now[at]
        start[at], size[at] = model.others(at, escaped)
        part = width >> np.uint64(FLAG_BITS + SPAN_BITS)
        moved, width = low + part * start, part * size
        carry = np.flatnonzero(moved < low)
        if carry.size:
            flat[spot[carry] - 1] += np.uint64(1)
        low = moved
        at = np.flatnonzero(width < WIDE)
        held, places = low[at], spot[at]
        flat[places] = held >> SHIFT
        spot[at] = places + 1
        low[at] = held << SHIFT
        width[at] <<= SHIFT
        model.learn(now, entry, flag, escaped, wrong2, wrong1)
    top = low + (WIDE - np.uint64(1))  # one more word names a point of the last range
    carry = np.flatnonzero(top < low)
    flat[spot[carry] - 1] += np.uint64(1)
    flat[spot] = top >> SHIFT
    while (over := words >> SHIFT).any():
        words &= WIDE - np.uint64(1)
        words[:, :-1] += over[:, 1:]
    filled = spot - first
    used = np.arange(1, steps + 2)[None, :] <= filled[:, None]
    head = struct.pack("<IIII", len(block), len(letters), lanes, zlib.crc32(block.astype("<u4").tobytes()))
    body = b"".join([MAGIC, head, filled.astype("<u2").tobytes(), letters.astype("<u2").tobytes(), words[:, 1:][used].astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def _decoded(raw: bytes) -> np.ndarray:
    if raw[:4] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a block's checksum fails")
    length, size, lanes, crc = struct.unpack("<IIII", raw[4:20])
    steps = -(-length // lanes)
    counts = np.frombuffer(raw, "<u2", lanes, 20).astype(np.int64)
    letters = np.frombuffer(raw, "<u2", size, 20 + 2 * lanes)
    filled = np.frombuffer(raw[:-4], "<u4", -1, 20 + 2 * (lanes + size))
    # two words of zero follow each lane's own, and count as read after its last
    words = np.zeros(len(filled) + 2 * lanes, np.uint64)
    words[np.arange(len(filled)) + 2 * np.repeat(np.arange(lanes), counts)] = filled
    spot = np.cumsum(counts) - counts + 2 * np.arange(lanes)
    model = _Model(size, lanes)
    code, width = (words[spot] << SHIFT) | words[spot + 1], np.full(lanes, 2**64 - 1, np.uint64)
    spot += 2
    ids = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        context = model.predict()
        model.mixture(context)
        part = width >> np.uint64(FLAG_BITS + SPAN_BITS)
        point = code // part
        wrong2 = point >= model.all2
        neither = point >= model.all2 + model.all1
        flag = context + wrong2 + neither
        now, start, size = np.where(wrong2, model.guess1, model.guess2), model.all2 * wrong2, np.where(wrong2, model.all1, model.all2)
        at = np.flatnonzero(neither)
        escaped = model.other(at, point[at])
        now[at] = escaped
        start[at], size[at] = model.others(at, escaped)
        code -= part * start
        width = part * size
        entry = now << 2
        at = np.flatnonzero(width < WIDE)
        places = spot[at]
        code[at] = (code[at] << SHIFT) | words[places]
        spot[at] = places + 1
        width[at] <<= SHIFT
        ids[t] = now
        model.learn(ids[t], entry, flag, escaped, wrong2, (model.held1 ^ entry) > 3)
    out = letters[ids.T.reshape(-1)[:length]]
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("decoded ids don't match their checksum")
    return out


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each array of one to BLOCK ids below 65536 as one block of bytes."""
    return [_encoded(block) for block in blocks]


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where a checksum fails."""
    return [_decoded(raw) for raw in blocks]
