import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from strandweave.llm import packing  # noqa: E402


def test_the_plan_is_as_good_as_with_the_finest_bins():
    rng = random.Random(4)
    histogram = Counter(min(2048, int(rng.lognormvariate(6.5, 0.8)) + 1) for _ in range(20_000))
    counts = {w: sum(r.count for r in packing.plan_by_bins(histogram, 2048, w, 64)) for w in (8, 16)}
    best = sum(r.count for r in packing.plan_runs(histogram))
    assert best == min(counts.values()) < counts[16]
