import zlib
from itertools import product

import numpy as np
import pytest

from plumbline.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    model = toxicity.Model(emit=rng.normal(size=(3, 6)), chain=np.array([-0.5, 0.7, -0.4, 0.3]))
    rows = np.repeat(np.arange(30), rng.integers(1, 9, 30))
    bins = rng.integers(0, 6, len(rows)).astype(np.uint8)
    got = toxicity.marginals(model, bins, rows)
    for r in range(30):
        own = bins[rows == r].tolist()
        total, on = 0.0, np.zeros(len(own))
        for states in product((0, 1), repeat=len(own)):
            s = model.chain[3] * states[0]
            for t, y in enumerate(states):
                before, after = (own[t - 1] if t else 0), (own[t + 1] if t + 1 < len(own) else 0)
                s += y * (model.emit[0][before] + model.emit[1][own[t]] + model.emit[2][after] + model.chain[0])
                if t:
                    s += model.chain[1] * (not states[t - 1] and y) + model.chain[2] * (states[t - 1] and not y)
            total += np.exp(s)
            on += np.exp(s) * np.array(states)
        assert np.allclose(got[rows == r], on / total)


def test_fitting_raises_the_likelihood_of_planted_weights():
    rng = np.random.default_rng(1)
    bins = rng.choice(6, 20000, p=[0.9, 0.02, 0.02, 0.02, 0.02, 0.02]).astype(np.uint8)
    rows = np.arange(20000) // 40
    toxic = bins >= 4
    p = toxicity.marginals(toxicity.fit_chain(toxicity.Model(), bins, rows, toxic), bins, rows)
    assert p[toxic].mean() > 0.9 and p[~toxic].mean() < 0.02


def test_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op5_crf_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert all(d.text[s.start : s.end].isalnum() for s in r.spans)
    pairs = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(t == p for t, p in pairs) >= 0.93 * len(pairs)


@pytest.fixture
def tiny(spark):
    schema = "doc_id long, text string, toxic int, score double, spans string, held_out int"
    rows = [(i, ("kind words here " if i % 3 else "you idiot there ") * 3, 7, 0.5, "s", 1) for i in range(90)]
    rows += [(None, "you idiot", 1, 0.5, "s", 1), (500, None, 1, 0.5, "s", 1), (501, "", 1, 0.5, "s", 1), (502, "IDIOT! é idiots", 1, 0.5, "s", 1), (502, "fine", 1, 0.5, "s", 1)]
    return spark.createDataFrame(rows, schema)


def test_edge_rows(spark, tiny):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(1, 0), (None, 1), (2, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(tiny, labels)
    got = toxicity.score(tiny, model)
    rows = got.collect()
    assert len(rows) == tiny.count()
    by = {(r.doc_id, r.predicted) for r in rows if r.doc_id is None or r.doc_id >= 500}
    assert by == {(None, 1), (500, 0), (501, 0), (502, 1), (502, 0)}
    (odd,) = [r for r in rows if r.doc_id == 502 and r.predicted]
    assert (odd.spans[0].start, odd.spans[0].end) == (0, 5)
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and r.doc_id < 90)
    assert toxicity.score(tiny.limit(0), model).collect() == []
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert not any(r.predicted for r in toxicity.score(tiny, toxicity.fit(tiny, few)).collect())
