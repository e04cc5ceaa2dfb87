"""Ids of runs of texts, taken apart and kept, against the tokenizers library on each text."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyweft.llm.word_ids import WordIds

PATH = public_tokenizers.path("byte_bpe_50k.json")
OF, LIBRARY = WordIds(PATH), Tokenizer.from_file(PATH)
PARTS = st.sampled_from([" ", " ", " ", "\n", "\n", "\t", "\r", "\x1c", "\x85", " ", " ", " ", "　", "​", "a", "the", "Word", "s", "'", "'s", "'t", "'ll", "12", "7", ".", ",", "_", "-", "(", "é", "ß", "ñ", "½", "日本", "́", "\U0001f389", "<|endoftext|>", "<|", "a" * 70])
TEXTS = st.lists(st.one_of(st.lists(PARTS, max_size=24).map("".join), st.text(st.characters(exclude_categories=["Cs"]), max_size=12)), max_size=6)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_as_the_library(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    ids, places = OF.ids(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [ids[s:e].tolist() for s, e in zip(places, places[1:], strict=False)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
