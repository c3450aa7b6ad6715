import hashlib

import corpus_pipeline
from plumbline.llm import bpe, queries
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_substrings import brute as brute_spans

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [r.text.split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(path := f"file://{tmp_path}/{name}")
        out = spark.read.parquet(path)
        if name == "tokens":
            want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in before.items()}
            assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == want
            sizes = {d: len(bpe.encoding(*_vocabulary()).encode_ordinary(t)) for d, t in before.items()}
            assert {r.doc_id: r.n_tokens for r in out.collect()} == sizes
            continue
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert after.keys() <= before.keys()
        ids = sorted(before)
        if name == "language":
            assert len(after) >= 0.97 * len(before) and after == {d: before[d] for d in after}
        elif name == "near_dedup":
            roots = brute_components([brute_print(before[d]) for d in ids])
            assert after == {ids[i]: before[ids[i]] for i in set(roots)}
        elif name == "line_dedup":
            want = dict(before)
            for d, a, b, _, _ in sorted(brute_spans(list(before.items())), reverse=True):
                want[d] = want[d][:a] + want[d][b:]
            assert after == want
            assert all(r.n_chars == len(r.text) for r in out.collect())
        else:
            held = {d for d, t in before.items() if any(f" {' '.join(i)} " in f" {' '.join(t.split())} " for i in items)}
            assert not held & after.keys()
            assert len(before) - len(after) <= len(held) + 0.02 * len(before)
        docs, before = out, after


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(docs.collect()) == sorted(queries.queries()["pipeline"](spark, SF).collect())


def test_one_text_of_an_id_goes_without_the_others(spark):
    rows = {(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    texts = sorted(t for _, t in rows if len(t) > 500)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = spark.createDataFrame([(5000, texts[0], "en", "s", 1), (5000, texts[1], "en", "s", 1), (4999, texts[1] + " ", "en", "s", 1), (6000, item, "en", "s", 1), (6000, texts[2], "en", "s", 1), (7000, "?", "en", "s", 1), (7000, texts[3], "en", "s", 1)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name, *ids: sorted((r.doc_id, r.text) for r in stages[name](spark, more, SF).collect() if r.doc_id in ids)
    assert kept("near_dedup", 4999, 5000) == [(4999, texts[1] + " "), (5000, texts[0])]
    assert kept("decontamination", 6000) == [(6000, texts[2])]
    whole = docs.unionByName(more)
    assert sorted(r.text for r in stages["language"](spark, whole, SF).collect() if r.doc_id == 7000) == [texts[3]]


def test_documents_with_nulls_and_more_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, dropped_id long, spans string, fp int, row string"
    rows = [(1, "the words of a text that is long enough for the stages"), (2, None), (3, ""), (None, "of the"), (4, "x" * 5000), (4, "the of and with")]
    docs = spark.createDataFrame([(*r, "en", "s", 3, 1, "s", 2, "r") for r in rows], schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if out.columns == docs.columns:
                assert out.dtypes == docs.dtypes
            frame = out
        frame.collect()
