"""Texts of a few megabytes are looked up together, so a piece that recurs in them is asked for once."""

from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa

from skyweft.llm import token_store
from skyweft.llm.queries import TOKENIZER
from skyweft.llm.word_ids import WordIds, word_ids


def test_one_lookup_for_three_megabytes(monkeypatch):
    asked, real, path = [], WordIds.ids, public_tokenizers.path(TOKENIZER)
    monkeypatch.setattr(WordIds, "ids", lambda self, data, offsets: asked.append(len(data)) or real(self, data, offsets))
    monkeypatch.setattr(token_store.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    texts = [f"some words and {i} " * 600 for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (segment,) = token_store._writer(path, 1 << 30)(iter([batch]))
    assert len(asked) == 1 and asked[0] > 3 << 20
    ids, lengths, tokens = token_store._opened(segment.column("body")[0].as_py())
    assert ids == list(range(300)) and int(lengths.sum()) == len(tokens)
    assert tokens[: lengths[0]].tolist() == [*word_ids(path).library.encode(texts[0], add_special_tokens=False).ids, 0]
