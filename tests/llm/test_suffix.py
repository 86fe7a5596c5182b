import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm import odd

from strandweave.llm import suffix_dedup, suffix_sort


def brute(texts, width):
    """Per text: which bytes repeated windows cover."""
    seen = Counter(t[p : p + width] for t in texts for p in range(len(t) - width + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                covered[p : p + width] = True
        out.append(covered)
    return out


def test_sorting():
    rng, r = np.random.default_rng(0), random.Random(0)
    for _ in range(200):
        n = r.randrange(1, 40)
        rows = rng.integers(97, 99, (n, r.choice([5, 16, 60, 200]))).astype(np.uint8)
        if n > 5:
            rows[1:, : min(rows.shape[1], 55)] = rows[0, : min(rows.shape[1], 55)]
            rows[3] = rows[2]
        got = [rows[i].tobytes() for i in suffix_sort.sort_rows(rows)]
        assert got == sorted(got)


def test_windows_of_segments():
    rng = random.Random(1)
    core, width = b"#ANCHOR#", 20
    segments, anchors = [], []
    for _ in range(60):
        left = bytes(rng.choice(b"ab") for _ in range(rng.randrange(4, 12)))
        right = bytes(rng.choice(b"ab") for _ in range(12 + rng.randrange(0, 4)))
        text = left + core + right
        if (text, len(left)) not in zip(segments, anchors, strict=True) and len(text) - width <= len(left):
            segments.append(text)
            anchors.append(len(left))
    found = suffix_sort.repeated_windows(segments, np.array(anchors), width)
    seen = Counter((s[p : p + width], a - p) for s, a in zip(segments, anchors) for p in range(len(s) - width + 1))
    for s, a, flags in zip(segments, anchors, found):
        assert flags.tolist() == [seen[s[p : p + width], a - p] > 1 for p in range(len(s) - width + 1)]
    assert suffix_sort.repeated_windows([], np.array([]), width) == []


def test_segments_cover_all_windows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1 << 10)
    monkeypatch.setattr(suffix_dedup, "_PLACE", 10)
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (30, 5, 0, 400, 3000, 20, 19)] + [b"z" * 200]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    text, lo, n, at = suffix_dedup.find_segments(data, starts, 20, 5)
    windows = Counter((t, p) for t, a, k in zip(text.tolist(), lo.tolist(), n.tolist()) for p in range(a, a + k))
    assert windows == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 19))
    by_window = {}
    for t, a, k, g in zip(text.tolist(), lo.tolist(), n.tolist(), at.tolist()):
        for p in range(a, a + k):
            assert p <= g <= p + 15  # the anchor lies in the window
            key = texts[t][p : p + 20]
            assert by_window.setdefault(key, g - p) == g - p  # and at the same place of equal windows


@pytest.mark.parametrize(("width", "gram", "max_group"), [(200, 40, 4096), (20, 5, 1), (20, 6, 50)])
def test_removal_against_brute_force(spark, width, gram, max_group):
    rows = [(d, t, lang, s) for d, t, lang, s in odd.texts() if width > 100 or len(t or "") < 5000]
    rows += [(200 + i, "shared passage that is found in many places. " + w, "en", "s") for i, w in enumerate("abcdefgh")]
    rows += [(300, "abcabcabcabc" * 30, "en", "s"), (301, "é" * 90 + "x" + "é" * 90, "fr", "s")]
    raw = [(t or "").encode() for _, t, *_ in rows]
    expect = Counter()
    for (d, *_), t, covered in zip(rows, raw, brute(raw, width)):
        spans = int((np.diff(np.concatenate([[0], covered.astype(int), [0]])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~covered])
        expect[d, len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.removed_passages(odd.docs(spark, rows), width, gram, max_group).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expect


def test_texts_without_repeated_passages(spark):
    docs = odd.docs(spark)
    got = suffix_dedup.remove_passages(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len(odd.texts())
    by_id = {r.doc_id: r.text for r in rows}
    assert by_id[6] is None and by_id[1] == by_id[2] == "" and by_id[12] == "x"
    assert by_id[4] and "clash" == rows[0].digest


def test_no_documents(spark):
    assert suffix_dedup.removed_passages(odd.docs(spark, [])).collect() == []
