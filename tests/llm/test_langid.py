import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_gram_sums_equal_a_loop():
    rng = np.random.default_rng(0)
    tables = np.zeros((2, (1 << 16) + 1), np.float32)
    tables[:, :-1] = rng.normal(size=(2, 1 << 16))
    texts = ["", "a", "ab", "abc", "Über 12 die Straße", "x" * 30, "?!"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sums, n = langid.gram_sums(tables, np.concatenate(raw), offsets)
    for i, r in enumerate(raw):
        codes, valid = langid._grams(r) if len(r) > 2 else (np.zeros(0, int), np.zeros(0, bool))
        assert n[i] == valid.sum()
        assert np.allclose(sums[i], tables[:, codes[valid]].sum(axis=1), atol=1e-4)


def test_query_finds_the_language(spark):
    rows = queries.op2_language_fusion(spark, SF).collect()
    got, of_pages = {r.doc_id: r for r in rows if r.page_id is None}, {r.page_id: r for r in rows if r.doc_id is None}
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1).alias("path")).collect()
    assert len(rows) == len(got) + len(of_pages) and of_pages.keys() == {p.page_id for p in pages}
    assert sum(of_pages[p.page_id].language == p.path for p in pages) >= 0.9 * len(pages)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert sum(got[d.doc_id].language == d.lang for d in docs) >= 0.99 * len(docs)
    long_ones = [d for d in docs if d.n_chars > 60]
    assert sum(got[d.doc_id].text_language == d.lang for d in long_ones) >= 0.97 * len(long_ones)
    assert sum(got[d.doc_id].kept for d in docs) >= 0.98 * len(docs)


def test_pages_with_markup_and_hosts(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    model = langid.fit(langid.documents_as_rows(docs))
    rows = langid.pages_as_rows(pages)
    found = langid.identify(rows, model).join(pages.select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1).alias("path")), "doc_id").collect()
    assert len(found) == pages.count()
    assert sum(r.language == r.path for r in found) >= 0.9 * len(found)
    first = rows.filter("doc_id = 1").first()
    assert (first.host, first.domain, first.suffix) == ("m.ththth.example.net", "example.net", "net")
    assert first.declared in ("en", "fr", "de", "es", None) and "<" not in first.text


def brute(rows, model):
    """Each row judged with the counts of all other rows, which are added up anew for it."""
    k = len(model.languages)
    soft = []
    for r in rows:
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        sums, n = langid.gram_sums(model.tables, raw, np.array([0, len(raw)]))
        logs = np.append(sums[0] / max(n[0], 1), -16 * math.log(2)) * min(n[0], langid.MOST_GRAMS) * langid.GRAM_WEIGHT
        p = np.exp(logs - logs.max()) * np.append(np.full(k, 1 - langid.BACKGROUND), langid.BACKGROUND)
        soft.append((logs, (p / p.sum())[:k] * (n[0] > 0), n[0] > 0))
    out = []
    for i, (r, (logs, _, has)) in enumerate(zip(rows, soft, strict=True)):
        others = [(o, s[1]) for j, (o, s) in enumerate(zip(rows, soft, strict=True)) if j != i]
        count = lambda match: sum((p for o, p in others if match(o)), np.zeros(k))  # noqa: E731,B023
        prior = count(lambda o: True) + 1
        prior = prior / prior.sum()
        for depth, level in enumerate(("suffix", "domain", "host")):
            if r[level] is not None:
                n = count(lambda o, upto=("suffix", "domain", "host")[: depth + 1], r=r: all(o[x] == r[x] for x in upto))
                prior = (n + langid.PRIOR_ROWS * prior) / (n.sum() + langid.PRIOR_ROWS)
        fused = logs + np.log(np.append(prior * (1 - langid.BACKGROUND), langid.BACKGROUND))
        if r["declared"] in model.languages:
            own = count(lambda o, r=r: o["declared"] == r["declared"]) + langid.DECLARED_ROWS
            seen = count(lambda o: o["declared"] in model.languages) + langid.DECLARED_ROWS * k
            fused += np.log(np.append(own / seen, own.sum() / seen.sum()))
        post = np.exp(fused - fused.max())
        post /= post.sum()
        out.append((r["doc_id"], [*model.languages, None][int(post.argmax())] if has else None, float(post.max()) if has else None))
    return out


def test_unmodelled_texts_go_and_rare_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    polish = "zażółć gęślą jaźń wiele słów po polsku tutaj stoi bardzo długo i szczęśliwie "
    rare = spark.createDataFrame([(10**6 + i, f"{polish} {i} " * 3, "pl-PL", "src1") for i in range(6)], "doc_id long, text string, lang string, source string")
    strange = [(2 * 10**6, "Это русский текст, и он довольно длинный, чтобы его узнать " * 5, "en", "src0"), (2 * 10**6 + 1, "qzxj vkqw zzxq pwqj kdkf jqpz " * 20, "en", "src0")]
    rows = langid.documents_as_rows(docs.unionByName(rare).union(spark.createDataFrame(strange, rare.schema)))
    model = langid.fit(rows.filter("doc_id < 2000000"))
    assert model.languages == ["de", "en", "es", "fr", "pl"]
    got = {r.doc_id: r for r in langid.identify(rows, model).filter("doc_id >= 1000000").collect()}
    assert all(got[10**6 + i].language == "pl" and got[10**6 + i].kept for i in range(6))
    assert not any(got[i].kept or got[i].language for i, *_ in strange)


def test_a_very_long_text_and_ties(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.documents_as_rows(docs))
    (text,) = [r.text for r in docs.filter("lang = 'de'").orderBy(F.desc("n_chars")).limit(1).collect()]
    frame = spark.createDataFrame([(1, text * (3_000_000 // len(text)), None, "a", None, None), (2, text, None, "b", None, None)], "doc_id long, text string, declared string, host string, domain string, suffix string")
    assert [r.language for r in langid.identify(frame, model).collect()] == ["de", "de"]
    even = langid.Model(["aa", "bb"], np.concatenate([model.tables[:1], model.tables[:1]]))
    assert {r.language for r in langid.identify(frame, even, least=0.4).collect()} == {"aa"}


@pytest.mark.parametrize("bytes_", [1 << 25, 0])
def test_fusion_equals_brute_force_on_odd_rows(spark, monkeypatch, bytes_):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.documents_as_rows(docs))
    base = [("the and of", "en"), ("der die und", "de"), ("le la de", "fr"), ("los de que", "es"), ("12 ?!", "en"), ("", None), ("th", "xx"), ("ünd schön", None)]
    monkeypatch.setattr(langid, "BROADCAST_BYTES", bytes_)
    places = [("a.x.com", "x.com", "com"), ("b.x.com", "x.com", "com"), ("c.y.fr", "y.fr", "fr"), (None, None, None), (None, "x.com", "com"), ("h", None, None)]
    rows = [{"doc_id": i * 10 + j if i else None, "text": t, "declared": d, "host": h, "domain": m, "suffix": s} for i, (h, m, s) in enumerate(places) for j, (t, d) in enumerate(base)]
    rows += rows[9:12]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, declared string, host string, domain string, suffix string")
    got = sorted(((r.doc_id, r.language, r.posterior) for r in langid.identify(frame, model).collect()), key=str)
    want = sorted(brute(rows, model), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all((g[2] is None) == (w[2] is None) and (g[2] is None or math.isclose(g[2], w[2], rel_tol=1e-6)) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables_and_clashing_columns(spark, n):
    schema = "doc_id long, text string, lang string, source string, n_chars long, language string, kept string, dropped_id int, p int"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "q", "r", 2, 3) for i, t in ((1, "words in here"), (2, None), (3, "..."), (None, ""))], schema).limit(4 * n)
    left = langid.keep_identified(docs)
    assert left.columns == docs.columns
    assert [r.doc_id for r in left.collect()] == [1] * n
