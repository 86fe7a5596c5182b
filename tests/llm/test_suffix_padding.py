import random
from collections import Counter

import numpy as np

from strandweave.llm import suffix_sort


def test_padding_is_not_taken_for_nul_bytes():
    matrix = np.zeros((3, 8), np.uint8)
    matrix[:, 0] = 7
    matrix[2, 7] = 1
    for lengths in ([8, 2, 8], [2, 8, 8]):
        numbers = suffix_sort.classes(matrix, np.array(lengths))(6)
        long = [n for n, size in zip(numbers, lengths) if size == 8]
        assert long[0] == long[1] and len(set(numbers)) == 2


def test_windows_with_long_runs_of_nul():
    rng = random.Random(5)
    core, width = b"#ANCHOR#", 20
    for _ in range(20):
        pairs = set()
        for _ in range(40):
            left = bytes(rng.choice(b"ab") for _ in range(rng.randrange(10, 13)))
            right = b"\0" * rng.randrange(0, 12) + bytes(rng.choice(b"\0\0\0a") for _ in range(rng.randrange(0, 4)))
            text = left + core + right
            if width <= len(text) and len(text) - width <= len(left):
                pairs.add((text, len(left)))
        segments, anchors = zip(*rng.sample(sorted(pairs), len(pairs)))
        found = suffix_sort.repeated_windows(list(segments), np.array(anchors), width)
        seen = Counter((s[p : p + width], a - p) for s, a in pairs for p in range(len(s) - width + 1))
        for s, a, flags in zip(segments, anchors, found):
            assert flags.tolist() == [seen[s[p : p + width], a - p] > 1 for p in range(len(s) - width + 1)]
