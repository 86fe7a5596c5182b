import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from strandweave.llm import bpe, tokens  # noqa: E402
from tests.llm import odd  # noqa: E402

PATH = tokens.default_path()
MARK = "<|endoftext|>"


@pytest.fixture(scope="module")
def fresh():
    return Tokenizer.from_file(PATH)


def whole(fresh, text):
    return fresh.encode(text or "", add_special_tokens=False).ids


def unsplit():
    """Stretches without a sure cut: one run, changing runs, contractions and white space at every place."""
    rng = random.Random(5)
    yield from ("y" * 700, "abc" * 300, "日本語のテキスト" * 60, " " * 500, "\n\n \t" * 90, "12345" * 99, "=-" * 200, "ä" * 333, "'ll" * 150, "🎉é" * 80)
    for alphabet in ("ab", "theingaou", "日本語、。12", "a'slvred", "a \t　\n", "'’ls !", "0123456789abcdef", "étà̂ßn", "!?'\"-ab1"):
        for n in (1, 2, 17, 90, 400):
            for _ in range(6):
                yield "".join(rng.choice(alphabet) for _ in range(n))


def test_halves_join_to_the_encoding_of_the_whole(fresh):
    tree, rng = bpe.Tree(fresh), random.Random(6)
    for text in unsplit():
        for size in (1, 2, 3, 7, 40):
            if size < 3 and len(text) > 100:
                continue
            parts = [tree.leaf(text[i : i + size]) for i in range(0, len(text), size)]
            assert tree.whole(parts).ids.tolist() == whole(fresh, text), (text, size)
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1)))
        parts = [tree.leaf(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if b > a]
        got = tree.whole(parts)
        assert got.ids.tolist() == whole(fresh, text)
        assert got.starts.tolist() == [a for _, (a, _) in fresh.pre_tokenizer.pre_tokenize_str(text)]


def test_windows_stay_small(fresh):
    """Joining two long halves of one run encodes a few tokens, not the halves."""
    tree = bpe.Tree(fresh)
    rng = random.Random(7)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(40_000))
    left, right, seen = tree.leaf(text[:20_000]), tree.leaf(text[20_000:]), []
    plain = tree._bpe
    tree._bpe = lambda mapped: seen.append(len(mapped)) or plain(mapped)
    assert tree.join(left, right).ids.tolist() == whole(fresh, text)
    assert sum(seen) < 500


def test_leaves_give_the_text_back():
    enc = tokens.encoder(PATH)
    text = "word " * 50 + "y" * 300 + MARK + " a\n b" + "日" * 100 + MARK * 2 + "c d. " * 30
    parts = bpe.leaves(text, enc, 40)
    assert "".join(p for _, p in parts) == text
    assert max(len(p) for _, p in parts) <= 40
    assert any(on for on, _ in parts) and not parts[0][0]


def test_every_token_encodes_to_itself(fresh):
    """What the agreement of windows rests on."""
    added = set(fresh.get_added_tokens_decoder())
    assert all([t.id for t in fresh.model.tokenize(n)] == [i] for n, i in fresh.get_vocab().items() if i not in added)


def check(spark, rows, fresh, leaf):
    df = odd.docs(spark, rows)
    encoded = bpe.encode(df, ("doc_id", "row"), leaf=leaf)
    got = sorted((r.doc_id is None, r.doc_id or 0, tuple(i % 2**32 for i in r.ids)) for r in encoded.collect())
    assert got == sorted((r[0] is None, r[0] or 0, tuple(whole(fresh, r[1]))) for r in rows)
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in bpe.decode(encoded).collect())
    assert back == sorted((r[0] is None, r[0] or 0, fresh.decode(whole(fresh, r[1]), skip_special_tokens=False)) for r in rows)
    sums = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(encoded).collect()))
    expect = []
    for r in rows:
        ids = whole(fresh, r[1])
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expect.append((r[0] is None, r[0] or 0, len(ids), sha, hashlib.sha256(fresh.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sums == sorted(expect)


@pytest.mark.parametrize("leaf", [40, 1000, bpe.LEAF])
def test_documents_against_the_library(spark, fresh, leaf):
    rows = odd.texts()
    rows += [(1000 + i, t, None, None) for i, t in enumerate([f"a {MARK} b" * 30, MARK, "x" * 999 + MARK + "x" * 999, *list(unsplit())[::9]])]
    rows += [(2000, "日本語。" * 9000 + "w" * 40_000, "ja", "a"), (2000, "日本語。" * 9000 + "w" * 40_000, "ja", "a")]
    check(spark, rows, fresh, leaf)


def test_empty_table(spark):
    none = odd.docs(spark, [])
    assert bpe.digests(bpe.encode(none)).collect() == []
    assert bpe.decode(bpe.encode(none)).collect() == []


def test_bytes_that_are_no_text_decode_as_the_library_does(spark, fresh):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randrange(12))]) for i in range(300)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df).collect()}
    assert got == {i: fresh.decode(ids or [], skip_special_tokens=False) for i, ids in rows}
