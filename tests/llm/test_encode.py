import os
import random

import pytest

from quellwerk.llm.encode import TOKENIZER, encoder, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def _cases():
    rng = random.Random(2)
    letters = "abcdefgh äöüß ñçé 日本語 тест 0123 .,!?\n\t'’😀ـ"
    yield from ["a" * 5000 + " " + "xyz" * 300, "  \n\n  hello   ", "<|endoftext|> hi", "日本語" * 200, "don't we'll", "😀" * 400, "ab" * 3000]
    for n in (1, 2, 5, 40, 300):
        for _ in range(40):
            yield "".join(rng.choice(letters) for _ in range(n))


def test_equals_the_library(library):
    texts = list(_cases())
    flat, offsets = encoder().encode(texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t[:30]


def test_null_empty_repeated_and_clashing_columns(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "ja", 0), (3, "ja", 0), (4, " ", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in token_ids(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got) == 5 and got[4][1] == [220]
    assert token_ids(df.limit(0)).count() == 0


def test_long_words_by_matrix_and_heap_agree(library):
    enc = encoder()
    for word in (b"ab" * 60, b"q" * 200, "äöü".encode() * 30):
        assert enc._heap(word).tolist() == enc._matrix([word], len(word))[0].tolist() == library.encode(word.decode(), add_special_tokens=False).ids
