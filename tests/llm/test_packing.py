import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm import odd

pytest.importorskip("public_tokenizers")

from strandweave.llm import packing, tokens  # noqa: E402


@pytest.mark.parametrize("lengths", [[], [5] * 3, [2048] * 4 + [1], [1] * 10_000, [1025] * 7 + [1024] * 3, "many"])
def test_plan_places_every_document_in_few_sequences(lengths):
    if lengths == "many":
        rng = random.Random(2)
        lengths = [min(2048, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(20_000)]
    histogram = dict(Counter(lengths))
    runs = packing.plan_runs(histogram)
    placed = Counter()
    for run in runs:
        assert run.used() <= 2048 and run.count > 0
        for length, copies in run.items:
            placed[length] += copies * run.count
    assert placed == Counter(lengths)
    least = -(-sum(lengths) // 2048)
    over_half = sum(x > 1024 for x in lengths)
    assert sum(r.count for r in runs) <= max(least, over_half) * 1.01 + 1 or len(set(lengths)) <= 2


def test_least_squares_is_not_negative_and_fits():
    rng = np.random.default_rng(0)
    a, true = rng.random((20, 8)), np.array([3, 0, 0, 1, 0, 2, 0, 0.5])
    assert np.allclose(packing.nnls(a, a @ true), true, atol=1e-6)
    x = packing.nnls(a, rng.standard_normal(20))
    assert (x >= 0).all()


@pytest.mark.parametrize("seq_len", [2048, 50])
def test_pack_against_whole_encoding(spark, seq_len):
    rows = odd.texts()
    enc = tokens.encoder(tokens.default_path())
    expect = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(enc.whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        head = len(ids) - (-(-len(ids) // seq_len) - 1) * seq_len
        cuts = [0, *range(head, len(ids) + 1, seq_len)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expect[doc_id, piece, a, b - a, zlib.crc32(ids[a:b])] += 1
    got = packing.pack(odd.docs(spark), seq_len=seq_len, salts=4).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expect
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len


def test_pack_of_nothing(spark):
    assert packing.pack(odd.docs(spark, [])).collect() == []
