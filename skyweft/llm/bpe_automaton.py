"""A tokenization automaton compiled from byte-pair merges.

Compiling starts from one state with a loop for every byte and applies a gadget for every merge u, v -> uv in
order of rank: the state behind u is copied without its arc for v (v may no longer follow u), and an arc uv
is added wherever an arc u led to a state with an arc v. So the state behind a token is fixed by the token, an
arc is either there or was taken away by one merge, and the state behind uv starts as the state behind v
while the arc uv starts with the holes of the arc u. Both inheritances are kept as chains with the rank at
which they were copied, instead of copying arcs: the arc t is missing behind s exactly if some merge joins a
member of s's chain to a member of t's chain at a rank before the state's copy and not after the arc's (the
gadget takes v away before it adds uv, so of three equal tokens the first two join). A merge whose u no longer has v
behind it adds nothing, and its token is on no arc. Every byte string is spelled by exactly one path.

Arcs are spelled byte by byte, so the automaton over bytes is not deterministic: after some bytes, several arcs
may be under way. Its states are made deterministic as sets of (state an arc left, place in the trie of labels),
numbered when first met, with a hashed table from (state, byte) to the next state. As a path's beginnings are
paths, exactly one arc ends after each byte; a deterministic state names it. Words are encoded by a transition a
byte, then read backwards: the arc that ends at the last byte, the one that ends where it began, and so on.
Nothing is tried and taken back. Decoding emits arc labels.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Regex, pre_tokenizers

from .base import small_batches, text_chunks

#: Fixed: the pre-split pattern of this public byte-level vocabulary, with its letters, numbers and spaces left open.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Code points by blocks, those of no character (surrogates) left out.
BLOCK = 2048
BLOCKS = [at for at in range(0, 0x110000, BLOCK) if not 0xD800 <= at < 0xE000]


@functools.cache
def pre_split(wide: bool) -> re.Pattern:
    """The pre-split with the classes of the installed tokenizers library, read from it block by block.

    Other packages class thousands of code points otherwise. Without `wide` the classes end at U+FFFF, which is
    much faster and right for texts that hold no character beyond.
    """
    classes = {}
    for name, of in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+")):
        found = pre_tokenizers.Split(Regex(of), "removed", invert=True)
        spans = [(at + a, at + b - 1) for at in BLOCKS if wide or at < 0x10000 for _, (a, b) in found.pre_tokenize_str("".join(map(chr, range(at, at + BLOCK))))]
        classes[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return re.compile(SPLIT.format(**classes))


def splitter(text: str) -> re.Pattern:
    """The pattern that splits this text."""
    return pre_split(not text.isascii() and re.search("[\U00010000-\U0010ffff]", text) is not None)


START = -1
#: Bounds of what a worker keeps; they affect speed and memory only.
MOST_KEPT, LONGEST_KEPT, MOST_STATES, LONG_TEXT = 300_000, 64, 150_000, 1 << 20


def _bytes_of_characters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        """labels: of every token; merges: (u, v, uv) by rank; special: texts that are tokens as a whole."""
        self.labels = labels
        self.sizes = [len(x) for x in labels]
        self.special = special
        never = len(merges)
        made = {both for _, _, both in merges}
        #: Whether a token is on any arc.
        self.live = [i not in made and len(x) == 1 and i not in set(special.values()) for i, x in enumerate(labels)]
        self.rank: dict[int, int] = {}
        #: Of a token: (member, rank of the copy) from itself on; behind it, and along its arc.
        self.behind: list[tuple[tuple[int, int], ...]] = [((i, never),) for i in range(len(labels))]
        self.arc: list[tuple[tuple[int, int], ...]] = list(self.behind)
        for rank, (u, v, both) in enumerate(merges):
            if self.live[u] and self.live[v] and self._joins(u, v):
                if self.live[both]:
                    raise ValueError("two merges make one token")
                self.live[both] = True
                self.behind[both] = ((both, never), *((x, min(r, rank)) for x, r in self.behind[v]))
                self.arc[both] = ((both, never), *((x, min(r, rank)) for x, r in self.arc[u]))
                self.rank[u << 32 | v] = rank
        self.known: dict[int, bool] = {}
        #: The trie of labels on arcs: (node, byte) -> node, and the token that ends at a node or -1.
        self.child: dict[int, int] = {}
        self.ends = [-1]
        for token, label in enumerate(labels):
            if self.live[token]:
                node = 0
                for byte in label:
                    key = node << 8 | byte
                    if key not in self.child:
                        self.child[key] = len(self.ends)
                        self.ends.append(-1)
                    node = self.child[key]
                self.ends[node] = token
        self.words: dict[str, bytes] = {}
        self._restart()

    def _restart(self) -> None:
        """Only the state before any byte, and an empty table."""
        self.sets: list[tuple[tuple[int, int], ...]] = [((START, 0),)]
        self.numbers = {self.sets[0]: 0}
        self.ended = [-1]
        self.table: dict[int, int] = {}

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _bytes_of_characters()
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for text, i in vocab.items():
            labels[i] = text.encode() if text in special else bytes(of[c] for c in text)
        for text, i in special.items():
            labels[i] = text.encode()
        merges = []
        for pair in spec["model"]["merges"]:
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        return cls(labels, merges, special)

    def _joins(self, state: int, token: int) -> bool:
        """Whether the arc `token` is there behind `state` after the merges so far."""
        get = self.rank.get
        for x, a in self.behind[state]:
            for y, b in self.arc[token]:
                r = get(x << 32 | y)
                if r is not None and r < a and r <= b:
                    return False
        return True

    def has_arc(self, state: int, token: int) -> bool:
        """Whether `token` may follow the state behind `state`; any may begin."""
        if state == START:
            return True
        key = state << 32 | token
        known = self.known.get(key)
        if known is None:
            if len(self.known) > MOST_KEPT:
                self.known.clear()
            known = self.known[key] = self._joins(state, token)
        return known

    def _next(self, state: int, byte: int) -> int:
        """The transition of the deterministic automaton, entered into the table."""
        under_way, ended = [], -1
        for left, node in self.sets[state]:
            now = self.child.get(node << 8 | byte)
            if now is not None:
                under_way.append((left, now))
                token = self.ends[now]
                if token >= 0 and self.has_arc(left, token):
                    ended = token
        if ended < 0:
            raise ValueError("no path spells the word")
        found = (*under_way, (ended, 0))
        number = self.numbers.get(found)
        if number is None:
            number = self.numbers[found] = len(self.sets)
            self.sets.append(found)
            self.ended.append(ended)
        self.table[state << 8 | byte] = number
        return number

    def path(self, word: bytes) -> list[int]:
        """The one path that spells word."""
        if len(self.sets) > MOST_STATES or len(self.table) > 4 * MOST_STATES:
            self._restart()
        state, last, get, ended = 0, [], self.table.get, self.ended
        for byte in word:
            now = get(state << 8 | byte)
            state = self._next(state, byte) if now is None else now
            last.append(ended[state])
        out, at, sizes = [], len(word), self.sizes
        while at:
            out.append(last[at - 1])
            at -= sizes[out[-1]]
        out.reverse()
        return out

    def packed(self, word: str) -> bytes:
        """A pre-split word's ids as little-endian unsigned 32-bit integers; words seen are kept, up to a bound of bytes."""
        found = np.array(self.path(word.encode()), "<u4").tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self.words) > MOST_KEPT:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """ids of a text, packed; special tokens in it are tokens."""
        split = splitter(text)
        if self.special and any(x in text for x in self.special):
            out = []
            for piece in re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text):
                out.append(np.array([self.special[piece]], "<u4").tobytes() if piece in self.special else self._plain(piece, split))
            return b"".join(out)
        return self._plain(text, split)

    def _plain(self, text: str, split) -> bytes:
        get, packed = self.words.get, self.packed
        if len(text) > LONG_TEXT:  # its words are never held together
            return b"".join(get(m[0]) or packed(m[0]) for m in split.finditer(text))
        return b"".join([get(w) or packed(w) for w in split.findall(text)])

    def decode(self, ids: bytes) -> str:
        """Emit the arcs' labels; bytes that are no UTF-8 become replacement characters."""
        labels, numbers = self.labels, np.frombuffer(ids, "<u4")
        parts = [b"".join([labels[i] for i in numbers[at : at + LONG_TEXT].tolist()]) for at in range(0, len(numbers), LONG_TEXT)]
        return b"".join(parts).decode("utf-8", "replace")


_loaded: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compiled once a worker."""
    if path not in _loaded:
        _loaded[path] = Automaton.load(path)
    return _loaded[path]


def _rows(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for rows, data, offsets in text_chunks(batches):
            raw, out = data.tobytes(), []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = machine.encode(raw[s:e].decode("utf-8", "replace"))
                text = machine.decode(ids)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *((np.frombuffer(ids, "<i4"), text) if keep else ())))
            columns = list(zip(*out, strict=True))
            arrays = [rows.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                arrays += [pa.array([x.tolist() for x in columns[3]], pa.list_(pa.int32())), pa.array(columns[4])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encode_and_decode(docs: DataFrame, tokenizer: str, keep: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    A null or empty text has no tokens and decodes to an empty text. Rows are handled one by one, so null or
    repeated doc_ids and equal texts keep a row each; an empty table gives no rows. Bytes that are no UTF-8 count as
    replacement characters. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows(tokenizer, keep), schema)
