"""The pre-split against the library's own, for every code point beside letters, numbers, signs and spaces."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from skyweft.llm import bpe_automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _same(text, library):
    wanted = [offsets for _, offsets in library.pre_tokenize_str(text)]
    found = [m.span() for m in bpe_automaton.splitter(text).finditer(text)]
    assert found == wanted, next((text[a : b + 3].encode("unicode_escape"), x) for (a, b), x in zip(found, wanted, strict=False) if (a, b) != x)


def test_every_code_point_is_split_as_the_library_does():
    library = Tokenizer.from_file(PATH).pre_tokenizer
    for at in bpe_automaton.BLOCKS:
        for few in range(at, at + bpe_automaton.BLOCK, 64):
            _same("".join(f"a{c}1{c}!{c} {c}'s" for c in map(chr, range(few, few + 64))), library)


def test_random_texts_encode_as_the_library_does():
    library, machine, chance = Tokenizer.from_file(PATH), bpe_automaton.automaton(PATH), random.Random(5)
    odd = "".join(map(chr, [0x558, 0xC5C, 0x323B0, 0x3FC3F, 0x85, 0xA0, 0x1C, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x10FFFF]))
    for _ in range(3000):
        text = "".join(chance.choice("ab 's1,\n" + odd) for _ in range(chance.randint(0, 30)))
        assert list(memoryview(machine.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids
