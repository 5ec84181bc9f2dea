"""The cached encoder against the library on whole texts."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.encode import Encoder
from lodestar.llm.queries import tokenizer_path
from lodestar.llm.token_files import Code, code_lengths
from lodestar.llm.wordhash import text_slices


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder(library):
    out = Encoder(tokenizer_path())
    out.fresh = library  # as the library opens it, not the encoder's own copy
    return out


def same(encoder, texts):
    for lo, hi, data, offsets in text_slices(pa.array(texts)):
        ids, n = encoder.encode(data, offsets)
        at = 0
        for text, size in zip(texts[lo:hi], n.tolist()):
            assert ids[at : at + size].tolist() == encoder.fresh.encode(text or "", add_special_tokens=False).ids, repr(text)
            at += size


def test_awkward_texts(encoder):
    same(encoder, ["it's o'clock 'tis", "Ünï 2024²x½ — “quoted” it’s", "á école ß İ", "", None, " \n\t", "日本語 テキスト!!", "É'S ÉTÉ'll x÷y×z", "nb sp", "<|endoftext|> #", "a\x00b \x1c c", "é Å"])


def test_special_tokens(encoder, library):
    texts = ["a <|endoftext|> b", "a<|endoftext|>b it's", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|> x", "plain", "", "é<|endoftext|><|endoftext|>"]
    same(encoder, texts)
    plain = Encoder(tokenizer_path(), plain=True)
    library_plain = plain.library
    assert library_plain.encode_special_tokens and not library.encode_special_tokens
    for lo, hi, data, offsets in text_slices(pa.array(texts)):
        ids, n = plain.encode(data, offsets)
        assert ids.tolist() == [i for t in texts[lo:hi] for i in library_plain.encode(t, add_special_tokens=False).ids] and ids.max() < 49406


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbz09 .,!'-\n\té×÷ß—'s"), st.characters(blacklist_categories=("Cs",))), max_size=30), max_size=5))
def test_any_text(encoder, texts):
    same(encoder, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=300), min_size=1, max_size=6), st.integers(4, 16))
def test_code_round_trip(docs, bits):
    import numpy as np

    ids = np.array([i for d in docs for i in d], np.int64)
    used, counts = np.unique(ids, return_counts=True)
    code = Code(used, code_lengths(counts, bits))
    assert not len(used) or sum(2.0 ** -int(x) for x in code.lengths) <= 1 and code.bits <= max(bits, (len(used) - 1).bit_length())
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    data, at, marks, _ = code.encode(ids, bounds)
    assert code.decode(data, np.diff(bounds), np.diff(at), marks).tolist() == ids.tolist()
