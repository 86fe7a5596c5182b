import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm import odd

pytest.importorskip("public_tokenizers")

from strandweave.llm import rans, tokens  # noqa: E402
from strandweave.session import scratch_folder  # noqa: E402


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(rans, "LANES", 16)
    monkeypatch.setattr(rans, "SEGMENT", 64)
    monkeypatch.setattr(rans, "BLOCK", 300)


@pytest.mark.parametrize("sizes", [[0], [1], [3, 0, 5], [40] * 30, [1000, 2, 7]])
def test_image_round_trip(small, sizes):
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.4, sum(sizes)), 50_256).astype(np.uint32)
    names = [None, *range(1, len(sizes))]
    got, got_sizes, got_names = rans.decode_image(rans.encode_image(ids, np.array(sizes), names))
    assert got.tolist() == ids.tolist() and got_sizes.tolist() == sizes and got_names == names


def test_a_segment_decodes_from_its_checkpoint(small):
    ids = np.arange(500, dtype=np.int64) % 7
    table = rans.Table.of(ids)
    data = memoryview(rans.encode_block(ids, table))
    n, lanes, per, marks, words, _ = np.frombuffer(data, "<u4", 6)
    size = 8 + 8 * int(lanes)
    stream = np.frombuffer(data, "<u4", int(words), 24 + int(marks) * size)
    pos = 24 + 2 * size  # the third checkpoint
    step, word = np.frombuffer(data, "<u4", 2, pos)
    out = np.zeros(int(n), np.uint32)
    rans.decode_segment(stream, int(word), np.frombuffer(data, "<u8", int(lanes), pos + 8).copy(), int(step), int(step + per), out, table)
    a, b = int(step * lanes), int((step + per) * lanes)
    assert marks > 3 and out[a:b].tolist() == ids[a:b].tolist()


def test_damage_is_told(small):
    image = bytearray(rans.encode_image(np.arange(400, dtype=np.uint32) % 11, np.array([400]), [1]))
    for at in (30, len(image) - 20, len(image) - 2):
        bad = bytearray(image)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            rans.decode_image(bytes(bad))
    with pytest.raises(ValueError):
        rans.decode_image(b"none")


def test_coding_is_near_the_entropy():
    rng = np.random.default_rng(2)
    ids = rng.geometric(0.05, 300_000).astype(np.uint32)
    share = np.bincount(ids)[1:] / len(ids)
    bits = -(share[share > 0] * np.log2(share[share > 0])).sum() * len(ids)
    assert len(rans.encode_image(ids, np.array([len(ids)]), [1])) * 8 < bits * 1.2


def test_files_hold_all_ids_in_order(spark):
    enc, rows = tokens.encoder(tokens.default_path()), odd.texts()
    folder = scratch_folder(spark, "ids")
    rans.write_ids(odd.docs(spark), folder, image_tokens=500)
    got = sorted(rans.read_ids(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    coded = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(enc.whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        coded[doc_id, len(ids), zlib.crc32(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == coded


def test_no_documents(spark):
    folder = scratch_folder(spark, "ids")
    rans.write_ids(odd.docs(spark, []), folder)
    assert rans.read_ids(spark, folder).collect() == []
