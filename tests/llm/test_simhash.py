import random
import re
from collections import Counter

import pytest
import xxhash
from tests.llm import odd

from strandweave.llm import graph, simhash


def brute_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, radius=2):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_tree_finds_all_within_the_radius():
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(200)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:150]]
    tree = simhash.BKTree(values + values[:5])
    for v in values + [0, 1]:
        assert sorted(tree.within(v, 2)) == sorted({w for w in values if (v ^ w).bit_count() <= 2})
    assert simhash.BKTree().within(3, 2) == []


def test_fingerprints():
    for _, text, *_ in odd.texts():
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_groups_on_odd_rows(spark):
    rows = odd.texts()
    got = simhash.near_duplicates(odd.docs(spark)).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_groups(fps)
    ids = {}
    for r, (d, *_) in zip(root, rows):
        ids[r] = min((x for x in (ids.get(r), d) if x is not None), default=None)
    expect = Counter((d, f"{f:016x}", ids[r]) for (d, *_), f, r in zip(rows, fps, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expect


@pytest.mark.parametrize("max_shard", [2, 4096])
def test_links_of_crowded_shards(spark, max_shard):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 250:
        v = rng.choice(sorted(values))
        values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.9 else rng.getrandbits(64))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), max_shard)
    roots = {r.node: r.root for r in graph.components(found).collect()}
    expect = brute_groups(list(values))
    for i, v in enumerate(signed):
        same = {signed[j] for j, r in enumerate(expect) if r == expect[i]}
        assert roots.get(v, v) == min(same)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (3, 3), (20, 21), (21, 22), (22, 23), (23, 24), (2, 1)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    expect = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert {r.node: r.root for r in got} == expect and len(got) == len(expect)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_first_of_each_group_stays(spark):
    docs = odd.docs(spark)
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert sorted(kept, key=str) == sorted({c for _, c in groups}, key=str)
    assert 1 in kept and 2 not in kept and kept.count(12) == 1


def test_no_documents(spark):
    assert simhash.near_duplicates(odd.docs(spark, [])).collect() == []
