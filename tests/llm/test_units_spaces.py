"""Units that begin with several spaces, and words around line feeds, get the library's ids in any company."""

import random

import numpy as np
import pytest

from asofia.llm import units

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "Word", "été", "²", "ɐ", "слово", "12", "_", "'s", "́", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r", "\x1c", " ", "\xa0", ".", "!!", "###", "'", "<|", "|>", "<|endoftext|>"]


@pytest.mark.parametrize("whole", [False, True])
def test_units_among_spaces(monkeypatch, whole):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = not whole
    rng = random.Random(5)
    texts = ["ab", "\t\tfoo", "ab", "\r\r\rfoo", "one\ntwo", "one.\nTwo!!\n", "one \ntwo", "\n", "\n\nx", "one \n two", "x###"]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(6_000)]
    monkeypatch.setattr(units, "MOST_UNITS", 2_000)
    tokens = units.TokenIds(PATH, whole)
    for a in range(0, len(texts), 500):
        ids, n = tokens.encode(texts[a:a + 500])
        want = [e.ids for e in library.encode_batch(texts[a:a + 500], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_words_are_encoded_once_whatever_stands_around_them(monkeypatch):
    tokens, seen = units.TokenIds(PATH), []
    encode = tokens._words
    monkeypatch.setattr(tokens, "_words", lambda texts: seen.extend(texts) or encode(texts))
    tokens.encode(["in word word. word, word### word.\nWord Word.\nWord!!"])
    assert sorted(seen) == [" Word", " word", "Word", "in"]
