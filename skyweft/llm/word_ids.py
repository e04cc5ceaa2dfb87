"""Ids of texts by the tokenizers library, with the ids of pieces kept.

A byte-level BPE never merges across its pre-split words, so a text may be cut where such a word surely ends:
before a single space, before and after a single line feed (both between characters that aren't white space),
and between ASCII letters, digits and punctuation, but for the apostrophe. A text's ids are those of its pieces,
one after the other. Pieces recur far more often than texts: the distinct ones of a run of texts are looked up
once each, and the library is asked for those that aren't kept. A text that names a special token goes to the
library whole. What is kept affects speed only.

A line feed before a space or a letter is a word of its own, so pieces without white space inside are asked for
in groups, joined by line feeds, and their ids are cut at the line feed's.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

KEPT = 400_000
KEPT_LENGTH = 64
GROUP = 64
SOLID = re.compile(r" ?\S+")
BYTES = np.arange(256)
SPACE = np.isin(BYTES, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
# 1: digits, 2: letters, 4: punctuation but for the apostrophe; only different kinds side by side make 3, 5 or 6
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 4
KIND[48:58] = 1
KIND[65:91] = KIND[97:123] = 2
KIND[39] = 0
APART = np.isin(BYTES, [3, 5, 6])


class Kept:
    """Values of the keys met last: between KEPT and twice as many."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, keys: list[str]) -> list[bytes | None]:
        """The value of each key, None where it isn't kept."""
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        for i in [i for i, v in enumerate(out) if v is None]:
            key = keys[i]
            if key in old:
                out[i] = young[key] = old[key]
        return out


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"].encode() for x in json.load(f)["added_tokens"]]
        self.feed = self._asked(["\n"])[0]
        self.pieces = Kept()

    def _asked(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _asked_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with at most a space before it and no other white space."""
        if not pieces:
            return []
        groups = ["\n".join(pieces[i : i + GROUP]) for i in range(0, len(pieces), GROUP)]
        ids = np.frombuffer(self.feed.join(self._asked(groups)), "<u4")
        raw, feed = ids.tobytes(), int.from_bytes(self.feed, "little")
        ends = [*(4 * np.flatnonzero(ids == feed)).tolist(), len(raw)]
        if len(self.feed) != 4 or len(ends) != len(pieces):
            return self._asked(pieces)
        return [raw[s:e] for s, e in zip([0, *(e + 4 for e in ends)], ends, strict=False)]

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, asked for where they aren't kept."""
        out = self.pieces.known(pieces)
        new = [i for i, v in enumerate(out) if v is None]
        solid = [i for i in new if SOLID.fullmatch(pieces[i])]
        others = list(set(new).difference(solid)) if len(solid) < len(new) else []
        asked = self._asked_pieces([pieces[i] for i in solid]) + self._asked([pieces[i] for i in others])
        keep = self.pieces.young
        for i, ids in zip(solid + others, asked, strict=True):
            out[i] = ids
            if len(pieces[i]) <= KEPT_LENGTH:
                keep[pieces[i]] = ids
        return out

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start, in ascending order: every text that isn't empty, and the cuts within."""
        raw = data.tobytes()
        space, kind = SPACE[data], KIND[data]
        for m in WIDE_SPACE.finditer(raw):
            space[m.start() : m.end()] = True
        alone = ~(space[:-2] | space[2:])
        cut = APART[kind[1:] | kind[:-1]]  # before the second byte, the third, ...
        cut[:-1] |= (data[1:-1] == 32) & alone
        feed = (data[1:-1] == 10) & alone
        cut[:-1] |= feed
        cut[1:] |= feed
        at = np.flatnonzero(cut) + 1
        starts, ends = offsets[:-1], offsets[1:]
        text = np.searchsorted(ends, at, "right")
        # a cut at a text's last byte may rest on the next text's first
        inside = (at + 1 < ends[text]) & (at > starts[text])
        inside &= (at > starts[text] + 1) | (data[at - 1] != 10)
        for special in self.special:
            if special in raw:
                named = np.array([special in raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
                inside &= ~named[text]
        return np.sort(np.concatenate([at[inside], starts[ends > starts]]), kind="stable")

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids); texts are UTF-8 bytes between offsets."""
        cuts = self._cuts(data, offsets) if len(data) > 2 else np.unique(offsets[:-1][np.diff(offsets) > 0])
        if not len(cuts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        places = np.append(cuts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        found = self._of_pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = pool[np.arange(ends[-1]) + np.repeat(begins[which] - ends + counts, counts)]
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(cuts, offsets)]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """Loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
