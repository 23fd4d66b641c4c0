import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from lantern.llm import token_files  # noqa: E402


def test_white_space_twice_as_python_has_it():
    every = [chr(i) * 2 for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    got = pc.match_substring_regex(pa.array(every, pa.large_string()), token_files._UNSAFE).to_pylist()
    assert [bool(g) for g in got] == [bool(re.search(r"\s\s", t)) for t in every] and sum(got) == 29


def test_ids_of_texts_with_all_white_space_as_the_library_has_them():
    space = [chr(i) for i in range(0x10000) if chr(i).isspace()]
    texts = [f"one{a}two,{b}three! one {a}{b} four{a}" for a in space for b in space] + ["", "\n", "a" * 100 + " " + "b" * 100 + " one"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = token_files.Encoder(path), tokenizers.Tokenizer.from_file(path)
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want == [x.tolist() for x in encoder.encode(texts)]


@pytest.mark.parametrize("ids", [[], [0, 1, 255, 256, 65_535, 65_536, 2**32 - 1]])
def test_ids_grouped_by_byte(ids):
    data = token_files.serialized(np.array(ids, np.uint32), 2)
    assert data == b"".join(bytes(i.to_bytes(4, "little")[k] for i in [*ids, 2]) for k in range(4))
    assert token_files.deserialized(data).tolist() == [*ids, 2]
