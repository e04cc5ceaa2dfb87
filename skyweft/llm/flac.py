"""FLAC media columns: bytes as 8-bit mono samples, stored losslessly and read back.

Streams are written with a STREAMINFO block, a SEEKTABLE of one point a frame, and frames of 1024 samples,
each of the cheapest of: constant, verbatim, fixed linear predictor of order 0 to 2 with Rice-coded
residuals. Reading verifies CRC-8 of frame headers, CRC-16 of frames and the MD5 of the samples. Frames that
one Rice partition codes are read in step, all frames of a run of rows at once; any other frame (LPC, Rice2,
several partitions, escapes, several channels, other sample sizes, no seek table) goes through the scalar reader.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import row_sums, small_batches, text_chunks

FRAME = 1024
RATE = 8000


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """CRC of every value of `bits` bits put in at the top of a register of `width` bits."""
    out = np.arange(1 << bits, dtype=np.uint32) << (width - bits)
    for _ in range(bits):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << width) - 1)
    return out


_CRC8 = _crc_table(0x07, 8, 8).tolist()
_CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)
_CRC16_BYTE = _crc_table(0x8005, 16, 8).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of data, two bytes of each at a time."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order].copy(), sizes[order]
    crc = np.zeros(len(order), np.uint16)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    pairs = padded[:-1].astype(np.uint16) << 8 | padded[1:]
    halves = left // 2
    for step in range(int(halves[0]) if len(halves) else 0):
        n = int(np.searchsorted(-halves, -step, "left"))  # those with more than `step` pairs
        crc[:n] = _CRC16[crc[:n] ^ pairs[at[:n] + 2 * step]]
    odd = np.flatnonzero(left & 1)
    last = data[at[odd] + left[odd] - 1]
    crc[odd] = (crc[odd] << 8) ^ _CRC16_BYTE[(crc[odd] >> 8) ^ last]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """Frame numbers are written like UTF-8, up to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 63)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(tail)])


def _frame_header(number: int, samples: int) -> bytes:
    full = samples == FRAME
    head = bytes([0xFF, 0xF8, (0b1010 if full else 0b0111) << 4, 0b0000_001_0]) + _coded_number(number)
    if not full:
        head += struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


#: Frames that are worked on together; it affects memory only.
GROUP = 4096


def _frames(payload: np.ndarray, start: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of frames one after the other, size of each): n samples from start on, numbered within their streams."""
    inside = np.arange(FRAME)[None, :] < n[:, None]
    first = int(start[0])
    own = payload[first : int(start[-1] + n[-1])]  # frames follow one another
    padded = np.concatenate([own, np.zeros(FRAME, np.uint8)])
    x = padded[start[:, None] - first + np.arange(FRAME)].astype(np.int16) - 128
    constant = ((x == x[:, :1]) | ~inside).all(axis=1)
    best, order, rice = np.where(constant, 16, 8 + 8 * n), np.where(constant, -2, -1), np.zeros(len(n), np.int64)
    residual, chosen = x, np.zeros(x.shape, np.uint16)
    for p in range(3):
        if p:
            residual = np.diff(residual, axis=1, prepend=np.int16(0))
        use = inside & (np.arange(FRAME)[None, :] >= p)
        zigzag = np.where(use, (residual << 1) ^ (residual >> 15), 0).astype(np.uint16)
        left = np.maximum(n - p, 1)
        k = np.clip(np.floor(np.log2(np.maximum(zigzag.sum(axis=1, dtype=np.int64) / left, 1))), 0, 14).astype(np.int64)
        bits = 8 + 8 * p + 10 + (n - p) * (1 + k) + (zigzag >> k[:, None].astype(np.uint16)).sum(axis=1, dtype=np.int64)
        better = (n > p) & (bits < best)
        best, order, rice = np.where(better, bits, best), np.where(better, p, order), np.where(better, k, rice)
        chosen[better] = zigzag[better]
    heads = [_frame_header(i, m) for i, m in zip(number.tolist(), n.tolist(), strict=True)]
    head_size = np.array([len(h) for h in heads], np.int64)
    frame_size = head_size + -(-best // 8) + 2
    at = np.concatenate([[0], np.cumsum(frame_size)])
    out = np.zeros(int(at[-1]), np.uint8)
    head_at = np.repeat(at[:-1] - np.cumsum(head_size) + head_size, head_size) + np.arange(int(head_size.sum()))
    out[head_at] = np.frombuffer(b"".join(heads), np.uint8)
    body = at[:-1] + head_size
    for kind in (-2, -1):
        rows = np.flatnonzero(order == kind)
        out[body[rows]] = 0 if kind == -2 else 0b0000_0010
        if kind == -2:
            out[body[rows] + 1] = x[rows, 0].astype(np.uint8)
        else:
            for f in rows.tolist():
                out[body[f] + 1 : body[f] + 1 + n[f]] = x[f, : n[f]].astype(np.uint8)
    rows = np.flatnonzero(order >= 0)
    if len(rows):
        p, k = order[rows], rice[rows]
        out[body[rows]] = (0b0010000 | (p << 1)).astype(np.uint8)
        for i in range(2):
            some = p > i
            out[body[rows[some]] + 1 + i] = x[rows[some], i].astype(np.uint8)
        coded = body[rows] + 1 + p  # 2 bits method, 4 bits partition order, 4 bits parameter, codes
        use = inside[rows] & (np.arange(FRAME)[None, :] >= p[:, None])
        z = chosen[rows].astype(np.int64)
        q = z >> k[:, None]
        length = np.where(use, q + 1 + k[:, None], 0)
        # One array of the bits of all residual parts, each from a byte boundary.
        room = frame_size[rows] - head_size[rows] - 3 - p
        base = np.cumsum(room) - room
        bits = np.zeros(8 * int(room.sum()), np.uint8)
        for j in range(4):
            bits[8 * base + 6 + j] = k >> (3 - j) & 1
        ends = np.cumsum(length, axis=1)
        stop = (8 * base + 10)[:, None] + ends - length + q  # the bit that ends the unary part
        stop, z, kk = stop[use], z[use], np.broadcast_to(k[:, None], use.shape)[use]
        bits[stop] = 1
        for j in range(int(k.max()) if len(k) else 0):
            some = kk > j
            bits[stop[some] + 1 + j] = z[some] >> (kk[some] - 1 - j) & 1
        packed = np.packbits(bits)
        target = np.repeat(coded - base, room) + np.arange(len(packed))
        out[target] = packed
    crc = crc16(out, at[:-1], frame_size - 2)
    out[at[1:] - 2], out[at[1:] - 1] = crc >> 8, crc & 255
    return out, frame_size


def encode(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One stream for each stretch [offsets[i], offsets[i+1]) of payload bytes, none of them empty."""
    sizes = np.diff(offsets)
    counts = -(-sizes // FRAME)
    doc = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[doc] + number * FRAME
    n = np.minimum(FRAME, offsets[doc + 1] - start)
    parts = [_frames(payload, start[i : i + GROUP], n[i : i + GROUP], number[i : i + GROUP]) for i in range(0, len(n), GROUP)]
    out, frame_size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    at = np.concatenate([[0], np.cumsum(frame_size)])
    raw, samples = out.tobytes(), (payload ^ 0x80).tobytes()
    streams, first = [], 0
    for i, c in enumerate(counts.tolist()):
        frames, size = slice(first, first + c), int(sizes[i])
        begin = int(at[first])
        info = struct.pack(">HH", FRAME, FRAME) + int(frame_size[frames].min()).to_bytes(3, "big") + int(frame_size[frames].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | size).to_bytes(8, "big") + hashlib.md5(samples[int(offsets[i]) : int(offsets[i + 1])]).digest()
        points = b"".join(struct.pack(">QQH", FRAME * j, int(at[first + j]) - begin, int(n[first + j])) for j in range(c))
        streams.append(b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[begin : int(at[first + c])])
        first += c
    return streams


class _Bits:
    """Scalar bit reader."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("the stream is cut short")
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _subframe(bits: _Bits, n: int, width: int) -> list[int]:
    """A channel of a frame: constant, verbatim, fixed or linear prediction with Rice residuals."""
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * n
    elif kind == 1:
        out = [bits.signed(width) for _ in range(n)]
    else:
        if 8 <= kind <= 12:
            order, shift = kind - 8, 0
            weights = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]  # fixed by the format
            out = [bits.signed(width) for _ in range(order)]
        elif kind >= 32:
            order = kind - 31
            out = [bits.signed(width) for _ in range(order)]
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        else:
            raise ValueError("reserved subframe type")
        size = 4 + bits.take(2)
        if size > 5:
            raise ValueError("reserved residual coding")
        parts = bits.take(4)
        for part in range(1 << parts):
            k = bits.take(size)
            count = (n >> parts) - (order if part == 0 else 0)
            raw = bits.take(5) if k == (1 << size) - 1 else None
            for _ in range(count):
                if raw is None:
                    z = bits.unary() << k | bits.take(k)
                    r = z >> 1 ^ -(z & 1)
                else:
                    r = bits.signed(raw)
                out.append(r + (sum(w * out[-1 - i] for i, w in enumerate(weights)) >> shift))
    return [x << wasted for x in out] if wasted else out


def _head(data: bytes, at: int, info: dict) -> tuple[int, int, int, int, int]:
    """(samples, channel assignment, bits a sample, number, byte after) of a frame header; its CRC-8 is verified."""
    bits = _Bits(data, at)
    if bits.take(15) != 0b111111111111100:
        raise ValueError("no frame where one is expected")
    bits.take(1)
    block, rate, channels, size = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    first = bits.take(8)
    more = 0 if first < 128 else 7 - (first ^ 0xFF).bit_length()
    number = first if not more else first & ((1 << (6 - more)) - 1)
    for _ in range(more):
        number = number << 6 | bits.take(8) & 63
    if block in (6, 7):
        n = bits.take(8 * (block - 5)) + 1
    else:
        n = 192 if block == 1 else 576 << (block - 2) if block < 6 else 256 << (block - 8)
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    end = bits.at // 8
    if crc8(data[at:end]) != bits.take(8):
        raise ValueError("a frame header's CRC-8 fails")
    return n, channels, [info["bits"], 8, 12, 0, 16, 20, 24, 32][size], number, end + 1


def _frame(data: bytes, at: int, info: dict) -> tuple[list[list[int]], int]:
    """(samples by channel, byte after) of one frame, read bit by bit; its CRC-16 is verified."""
    n, assignment, width, _, body = _head(data, at, info)
    bits = _Bits(data, body)
    count = assignment + 1 if assignment < 8 else 2
    side = {8: 1, 9: 0, 10: 1}.get(assignment)
    out = [_subframe(bits, n, width + (c == side)) for c in range(count)]
    if assignment == 8:
        out[1] = [a - b for a, b in zip(*out, strict=True)]
    elif assignment == 9:
        out[0] = [a + b for a, b in zip(*out, strict=True)]
    elif assignment == 10:
        both = [(2 * m + (s & 1), s) for m, s in zip(*out, strict=True)]
        out = [[(m + s) >> 1 for m, s in both], [(m - s) >> 1 for m, s in both]]
    end = (bits.at + 7) // 8
    raw = np.frombuffer(data, np.uint8)
    if int(crc16(raw, np.array([at]), np.array([end - at]))[0]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("a frame's CRC-16 fails")
    return out, end + 2


def metadata(data: bytes) -> dict:
    """STREAMINFO and seek points of a stream, and where its frames begin."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info = 4, False, {"points": []}
    while not last:
        last, kind, size = data[at] >= 128, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info |= {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34]}
        elif kind == 3:
            info["points"] = [p for i in range(0, size - 17, 18) if (p := struct.unpack(">QQH", block[i : i + 18]))[0] != 2**64 - 1]
        at += 4 + size
    return info | {"frames": at}


def decode_stream(data: bytes) -> list[list[int]]:
    """Any stream, by the scalar reader: samples by channel."""
    info = metadata(data)
    out, at = [[] for _ in range(info["channels"])], info["frames"]
    while at < len(data):
        frame, at = _frame(data, at, info)
        for c, x in enumerate(frame):
            out[c] += x
    return out


def _samples(data: np.ndarray, begin: np.ndarray, body: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Samples of 8-bit mono frames in step, a row each; CRC-16 is verified. data: the frames' bytes and eight more."""
    crc = crc16(data, begin, end - begin - 2)
    if ((crc >> 8) != data[end - 2]).any() or ((crc & 255) != data[end - 1]).any():
        raise ValueError("a frame's CRC-16 fails")
    kind = data[body].astype(np.int64) >> 1
    order = kind - 8
    parts = (data[body + 1 + np.clip(order, 0, 4)] >> 2) & 15
    k = (data[body + 1 + np.clip(order, 0, 4)].astype(np.int64) & 3) << 2 | data[body + 2 + np.clip(order, 0, 4)] >> 6
    rice = (order >= 0) & (order <= 2) & (data[body + 1 + np.clip(order, 0, 4)] >> 6 == 0) & (parts == 0) & (k < 15) & (data[body] & 1 == 0)
    x = np.zeros((len(n), int(n.max())), np.int32)
    for f in np.flatnonzero(~rice).tolist():
        raw = data[body[f] : end[f] - 2]
        if kind[f] == 1 and not raw[0] & 1:
            x[f, : n[f]] = raw[1 : 1 + n[f]].view(np.int8)
        else:
            x[f, : n[f]] = _subframe(_Bits(raw.tobytes()), int(n[f]), 8)
    rows = np.flatnonzero(rice)
    if len(rows):
        rows = rows[np.argsort(-(n - order)[rows], kind="stable")]
        p, k, left = order[rows], k[rows], (n - order)[rows]
        ones = np.flatnonzero(np.unpackbits(data))
        nth = np.searchsorted(ones, 8 * (body[rows] + 1 + p) + 10)
        pos = 8 * (body[rows] + 1 + p) + 10
        window = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
        residual = np.zeros((int(left[0]), len(rows)), np.int32)
        upto = np.searchsorted(-left, -np.arange(int(left[0])), "left")  # lanes with more than t residuals
        mask = (1 << k) - 1
        for t in range(int(left[0])):
            m = int(upto[t])
            stop = ones[nth[:m]]
            q = stop - pos[:m]
            after = stop + 1
            word = window[after >> 3].astype(np.int64)
            low = (word >> (32 - (after & 7) - k[:m])) & mask[:m]
            pos[:m] = after + k[:m]
            nth[:m] += 1 + np.bitwise_count(low)
            residual[t, :m] = q << k[:m] | low
        z = residual.T
        z = (z >> 1) ^ -(z & 1)
        for o in range(3):
            some = np.flatnonzero(p == o)
            if not len(some):
                continue
            r = z[some]
            if o == 2:  # first differences from the first warm-up difference on
                warm = data[body[rows[some]] + 1].view(np.int8).astype(np.int32), data[body[rows[some]] + 2].view(np.int8).astype(np.int32)
                r = np.cumsum(np.concatenate([(warm[1] - warm[0])[:, None], r], axis=1), axis=1)
                r = np.cumsum(np.concatenate([warm[0][:, None], r], axis=1), axis=1)
            elif o == 1:
                r = np.cumsum(np.concatenate([data[body[rows[some]] + 1].view(np.int8).astype(np.int32)[:, None], r], axis=1), axis=1)
            width = min(r.shape[1], x.shape[1])
            x[rows[some], :width] = r[:, :width]
    return x


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """8-bit mono streams to payload bytes, all frames in step; checksums are verified."""
    infos = [metadata(s) for s in streams]
    lanes, base, slow = [], 0, set()
    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        points = info["points"]
        if info["channels"] != 1 or info["bits"] != 8 or sum(p[2] for p in points) != info["samples"]:
            slow.add(i)
        else:
            ends = [*(p[1] for p in points[1:]), len(s) - info["frames"]]
            for (first, offset, n), end in zip(points, ends, strict=True):
                begin = info["frames"] + offset
                m, assignment, width, _, body = _head(s, begin, info)
                if m != n or assignment or width != 8:
                    raise ValueError("a seek point doesn't match its frame")
                lanes.append((i, base + begin, base + body, base + info["frames"] + end, n, first))
        base += len(s)
    payloads = [np.zeros(info["samples"], np.uint8) for info in infos]
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    lanes = np.array(lanes, np.int64).reshape(-1, 6)
    for at in range(0, len(lanes), GROUP):
        doc, begin, body, end, n, first = lanes[at : at + GROUP].T
        low, high = int(begin.min()), int(end.max())
        x = _samples(data[low : high + 8], begin - low, body - low, end - low, n)
        for f, (i, m, start) in enumerate(zip(doc.tolist(), n.tolist(), first.tolist(), strict=True)):
            payloads[i][start : start + m] = (x[f, :m] + 128).astype(np.uint8)
    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        if i in slow:
            payloads[i] = (np.array(decode_stream(s)[0]) + (1 << (info["bits"] - 1))).astype(np.uint8)
        if hashlib.md5((payloads[i] ^ 0x80).tobytes()).digest() != info["md5"]:
            raise ValueError("the samples' MD5 fails")
    return payloads


def padded(data: np.ndarray, offsets: np.ndarray, unit: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch with zero bytes up to a positive multiple of `unit`."""
    sizes = np.diff(offsets)
    rooms = np.maximum(unit, -(-sizes // unit) * unit)
    ends = np.concatenate([[0], np.cumsum(rooms)])
    out = np.zeros(int(ends[-1]), np.uint8)
    out[np.repeat(ends[:-1] - offsets[:-1], sizes) + np.arange(int(sizes.sum()))] = data
    return out, ends


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, 1 << 20):
        streams = encode(*padded(data, offsets))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(streams, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, media): each text's bytes as a FLAC stream.

    A null text counts as empty and is 64 zero bytes. Every row gives a row; equal texts give equal streams; an empty
    table gives none.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_media, "doc_id long, n_bytes long, media binary")


def _pcm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            stream = batch.column(1)[i].as_py()
            payload = decode([stream])[0]
            points = metadata(stream)["points"] or [(0, 0, len(payload))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[i].as_py()] * len(points), pa.int64()), pa.array([p[0] for p in points], pa.int64()), pa.array([p[2] for p in points], pa.int64()), pa.array([payload[p[0] : p[0] + p[2]].tobytes() for p in points], pa.binary())],
                ["doc_id", "sample_offset", "n_samples", "pcm"],
            )


def pcm_blocks(media: DataFrame) -> DataFrame:
    """media(doc_id, media) -> (doc_id, sample_offset, n_samples, pcm): PCM blocks that can be sought by offset."""
    return media.select("doc_id", "media").where("media is not null").mapInArrow(_pcm, "doc_id long, sample_offset long, n_samples long, pcm binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        streams = batch.column(2).to_pylist()
        lengths = np.cumsum([0, *map(len, streams)])
        start = 0
        while start < len(streams):
            stop = max(start + 1, int(np.searchsorted(lengths, lengths[start] + (1 << 20), "right")) - 1)
            group = streams[start:stop]
            payloads = decode(group)
            flat = np.concatenate(payloads).astype(np.int16)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in payloads])])
            level = row_sums(np.abs(flat - 128), ends)
            step = np.abs(np.diff(flat, append=flat[-1:]))
            step[ends[1:] - 1] = 0
            steps = row_sums(step, ends)
            out = [
                (len(x), hashlib.sha256(raw := x.tobytes()).hexdigest(), zlib.crc32(raw[-64:]), len(s), hashlib.sha256(s).hexdigest(), f"level={int(a)};steps={int(b)};peak={int(x.max())};frames={-(-len(x) // FRAME)}")
                for x, s, a, b in zip(payloads, group, level, steps, strict=True)
            ]
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            start = stop


def features(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> what the streams hold when they are read back, and level features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
