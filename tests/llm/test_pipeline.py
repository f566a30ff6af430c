from collections import Counter

import corpus_pipeline
import numpy as np
from fleetspark.llm.shared import written

from .conftest import words_of
from .test_simhash import plain_components, plain_fingerprint
from .test_suffixes import plain
from .test_tokens import plain as plain_ids


def stages(spark, docs):
    """What each stage leaves, written and read again."""
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], "unused"), name))
    return out


def test_each_stage_on_its_own_input(spark, small):
    docs, texts = small
    given, known, distinct, cut, mixed, packed = stages(spark, docs)
    for frame in (known, distinct, cut, mixed):
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    assert {r.doc_id for r in known.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t)}

    ids = np.array(sorted(r.doc_id for r in known.collect()))
    groups = plain_components(ids, np.array([plain_fingerprint(texts[i]) for i in ids], np.uint64), 4)
    kept = {r.doc_id: r.text for r in distinct.collect()}
    assert set(kept) == set(groups.tolist()) and all(texts[i] == t for i, t in kept.items())

    _, later = plain(kept)
    left = {r.doc_id: words_of(r.text) for r in cut.collect()}
    for i, text in kept.items():
        assert left.get(i, []) == [w for k, w in enumerate(words_of(text)) if k not in later.get(i, ())]

    total = sum(map(len, left.values()))
    assert sum(len(words_of(r.text)) for r in mixed.collect()) == total
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(left) and max(times.values()) <= 3

    whole = plain_ids("word_bpe_49k.json", [r.text for r in mixed.collect()])
    pieces = packed.collect()
    assert sum(r.length for r in pieces) == sum(len(i) + 1 for i in whole)
    assert Counter(x for r in pieces for x in r.ids) == Counter(x for i in whole for x in [*i, 2])


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(found.columns)


def test_hard_rows(spark, hard, empty):
    out = stages(spark, hard)
    assert all(f.columns == hard.columns for f in out[:-1]) and out[-1].count() > 0
    assert stages(spark, empty)[-1].count() == 0
