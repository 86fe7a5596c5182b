import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from strandweave.llm import tokens  # noqa: E402


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.default_path())


def whole(enc, text):
    return enc.whole.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_whole_texts(enc):
    rng = random.Random(1)
    odd = ["", None, " a", "a ", "a  b", "a\n\nb", "a \nb", "\n", " ", "don't 'tis it's", "x\ty", "a b c", "日本 語 の", "a\x1cb c\x85d",
           "I'll  we've\n 'sx", "<|endoftext|> hi <|endoftext|>", "½ ² x² ª", "a\r\nb", "'s", "\n's", "a 's", "word,\nword. word!!' 'word"]
    odd += ["".join(rng.choice("ab' \n\t.é1²日,") for _ in range(rng.randrange(30))) for _ in range(2000)]
    ids, bounds = enc.encode(odd, 0)
    for i, text in enumerate(odd):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*whole(enc, text), 0], repr(text)


def test_a_full_cache_changes_nothing():
    small = tokens.Encoder(tokens.default_path(), limit=3)
    for text in ("one two three four five", "six seven. eight", "one two"):
        ids, _ = small.encode([text])
        assert ids.tolist() == whole(small, text)


def test_no_texts(enc):
    ids, bounds = enc.encode([], 0)
    assert len(ids) == 0 and bounds.tolist() == [0]


def test_slices_cover_all():
    texts = ["a" * n for n in (5, 0, 30, 2, 2)] + [None]
    parts = list(tokens.slices(texts, 10))
    assert [i for a, b in parts for i in range(a, b)] == list(range(6))
    assert np.all([b > a for a, b in parts])
