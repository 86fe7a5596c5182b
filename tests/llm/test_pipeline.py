"""Each stage on its own input against brute force, and the whole run."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from strandweave.llm.common import small_batches  # noqa: E402
from tests.llm import odd  # noqa: E402
from tests.llm.test_mixing import brute as brute_mix  # noqa: E402
from tests.llm.test_simhash import brute_fingerprint, brute_groups  # noqa: E402
from tests.llm.test_suffix import brute as brute_repeats  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def key(r):
    return (r.doc_id, r.text, r.lang, r.source, r.fingerprint)


def test_stages_in_order():
    assert list(STAGES) == ["language_id", "simhash_dedup", "suffix_array_dedup", "mixing", "packing"]


def test_every_stage_and_the_whole_run(spark, tmp_path):
    rows = odd.texts() + [(400, "A passage. " * 30 + "one end", "en", "a"), (401, "other start " + "A passage. " * 30, "en", "b")]
    odd.docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, given = docs.columns, docs.collect()

    out = STAGES["language_id"](spark, docs, str(tmp_path))
    assert out.columns == columns
    got = out.collect()
    kept = [r for r in given if any(c.isalpha() for c in r.text or "")]
    assert Counter(map(key, got)) == Counter(map(key, kept))

    out = STAGES["simhash_dedup"](spark, spark.createDataFrame(got, docs.schema), str(tmp_path))
    assert out.columns == columns
    roots = brute_groups([brute_fingerprint(r.text) for r in got])
    first = defaultdict(list)
    for root, r in zip(roots, got):
        first[root].append(r)
    ids = Counter(min((r.doc_id for r in g if r.doc_id is not None), default=None) for g in first.values())
    got = out.collect()
    assert Counter(r.doc_id for r in got) == ids

    out = STAGES["suffix_array_dedup"](spark, spark.createDataFrame(got, docs.schema), str(tmp_path))
    assert out.columns == columns
    raw = [r.text.encode() for r in got]
    left = Counter()
    for r, t, covered in zip(got, raw, brute_repeats(raw, 200)):
        text = bytes(np.frombuffer(t, np.uint8)[~covered]).decode("utf-8", "ignore")
        if text:
            left[r.doc_id, text] += 1
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == left

    out = STAGES["mixing"](spark, spark.createDataFrame(got, docs.schema), str(tmp_path))
    assert out.columns == columns
    expect = Counter()
    for (doc_id, size, _, _, taken), n in brute_mix([(r.doc_id, r.text, r.lang, r.source) for r in got]).items():
        expect[doc_id] += n * taken // max(size, 1)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter({d: n for d, n in expect.items() if n})

    whole = STAGES["packing"](spark, spark.createDataFrame(got, docs.schema), str(tmp_path)).collect()
    assert Counter(r.doc_id for r in whole if r.piece == 0) == Counter(r.doc_id for r in got)
    same = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in same) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole)


def test_without_labels_every_document_with_a_letter_stays(spark, tmp_path):
    rows = [(d, t, None, s) for d, t, _, s in odd.texts()]
    docs = odd.docs(spark, rows)
    got = Counter((r.doc_id, r.text) for r in STAGES["language_id"](spark, docs, str(tmp_path)).collect())
    assert got == Counter((d, t) for d, t, *_ in rows if any(c.isalpha() for c in t or "")) and len(got) > 50


def test_small_batches_bound_what_is_held_at_once():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": ["word " * (i % 400) for i in range(5000)]})
    parts = list(small_batches(iter([batch, batch.slice(0, 0)]), 1 << 16))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert max(p.nbytes for p in parts) < 4 << 16 and len(list(small_batches(iter([batch]), 1))) == 5000
