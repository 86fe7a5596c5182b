import random

import pytest

pytest.importorskip("public_tokenizers")

from tokenizers import AddedToken, Tokenizer  # noqa: E402

from strandweave.llm import tokens  # noqa: E402

MARK = "<|endoftext|>"


def texts():
    rng = random.Random(4)
    odd = [MARK, f"a {MARK} b", f"{MARK}{MARK}", f" {MARK}\n", f"x  {MARK}  y", f"a\n{MARK}b c", "<|endoftext|", f"<|endof{MARK}text|>", None, ""]
    return odd + ["".join(rng.choice([MARK, "<|x|>", "<|x|>y", "ab", " ", "\n", "'s", ".", "é", "<|"]) for _ in range(rng.randrange(20))) for _ in range(1000)]


def compare(path):
    fresh, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    ids, bounds = enc.encode(texts(), 0)
    assert len(bounds) == len(texts()) + 1
    for i, text in enumerate(texts()):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*fresh.encode(text or "", add_special_tokens=False).ids, 0], repr(text)


def test_the_end_marker_has_its_own_id():
    ids, _ = tokens.Encoder(tokens.default_path()).encode([f"a {MARK} b"])
    assert ids.tolist() == [64, 220, 50256, 275]


def test_ids_equal_those_of_a_fresh_tokenizer():
    compare(tokens.default_path())


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}])
def test_other_added_tokens(flags, tmp_path):
    more = Tokenizer.from_file(tokens.default_path())
    more.add_special_tokens([AddedToken("<|x|>", **flags), AddedToken("<|x|>y", normalized=False)])
    path = str(tmp_path / "more.json")
    more.save(path)
    compare(path)
