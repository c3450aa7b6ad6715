import random

import numpy as np
import pytest

from plumbline.llm import decontaminate as lsa
from plumbline.llm import queries

SF = "/root/testdata/sf0.01"


def words(text):
    out, w = [], ""
    for c in (text or "") + " ":
        if (c.isascii() and c.isalnum()) or not c.isascii():
            w += c.lower() if c.isascii() else c
        else:
            out += [w] if w else []
            w = ""
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def test_lcs_equals_the_table():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 90))] for _ in range(2))
        assert lsa.common_subsequence(a, b) == lcs(a, b)


def test_query_against_brute_force(spark):
    got = {(r.doc_id, r.item_id): r for r in queries.op9_latent_leaks(spark, SF).collect()}
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verbatim, near = set(), set()
    for d, text in docs:
        joined, bag = f" {' '.join(text)} ", set(text)
        for i, item in items:
            if f" {' '.join(item)} " in joined:
                verbatim.add((d, i))
            if sum(w in bag for w in item) >= 0.7 * len(item) and any(
                lcs(item, text[s : s + 2 * len(item)]) >= 0.7 * len(item) for s in range(0, max(1, len(text) - len(item)), max(1, len(item) // 2))
            ):
                near.add((d, i))
    assert len(verbatim) >= 3
    assert len(verbatim & got.keys()) >= 0.95 * len(verbatim)
    assert len((verbatim | near) & got.keys()) >= 0.9 * len(verbatim | near)
    for d, i in got:
        text, item = dict(docs)[d], dict(items)[i]
        assert lcs(item, text) >= lsa.PARAPHRASE * len(item)
    assert len({d for d, _ in got} - {d for d, _ in verbatim | near}) <= 0.005 * len(docs)


def test_paraphrases_and_clean_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(3, 9)))
    common = [word() for _ in range(30)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.45 else word() for _ in range(n)]
    items = [prose(rng.randint(18, 150)) for _ in range(40)]
    rows, want = [], set()
    for d in range(400):
        text = prose(rng.randint(30, 600))
        if d % 10 == 0:
            item = list(items[(d // 10) % 40])
            if d % 20 == 0:  # a sixth of the words replaced, the answer left
                for k in range(0, int(len(item) * 0.8), 6):
                    item[k] = word()
            at = rng.randint(0, len(text))
            text[at:at] = item
            want.add((d, (d // 10) % 40))
        rows.append((d, " ".join(text), "c"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(t), 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in lsa.leaks(docs, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    left = lsa.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(400)) - {d for d, _ in got}


@pytest.mark.parametrize("replaced", [0, 0.15])
def test_recall_by_length_with_thousands_of_items(spark, replaced):
    rng = random.Random(6)
    docs = [words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").collect()]
    docs = [d for d in docs if len(d) > 60]
    pool = [w for d in docs for w in d]
    items = [rng.sample(pool, rng.randint(15, 59)) for _ in range(2000)]
    rows = []
    for d, item in enumerate(items):
        text = rng.choice(docs)[:300]
        planted = [rng.choice(pool) if rng.random() < replaced else w for w in item]
        if lcs(item, planted) < lsa.COPY * len(item):
            planted = item
        at = rng.randint(0, len(text))
        rows.append((d, " ".join(text[:at] + planted + text[at:])))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in lsa.leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), bench).collect()}
    for lo, hi in ((15, 20), (21, 30), (31, 45), (46, 59)):
        want = {(d, d) for d, item in enumerate(items) if lo <= len(item) <= hi}
        assert len(want & got) >= 0.9 * len(want), (lo, hi, len(want & got) / len(want))


def test_latent_directions_span_the_largest_variance(spark):
    rng = np.random.default_rng(3)
    base = [rng.choice(lsa.TERMS, 40, replace=False).astype(np.uint16) for _ in range(12)]
    rows = [base[i % 12][rng.permutation(40)[:34]] for i in range(360)]
    frame = spark.createDataFrame([(r.tobytes(), 1.0) for r in rows], "terms binary, weight double").repartition(3)
    v = lsa.latent_terms(frame, np.ones(lsa.TERMS, np.float32))
    a = np.zeros((len(rows), lsa.TERMS), np.float32)
    for i, r in enumerate(rows):
        a[i, r] = 1 / np.sqrt(len(r))
    exact = np.sort(np.linalg.eigvalsh(a @ a.T))[-lsa.RANK :]  # squared singular values
    assert np.allclose(v.T @ v, np.eye(lsa.RANK), atol=1e-3)
    assert ((a @ v) ** 2).sum() >= 0.97 * exact.sum()


def test_directions_come_from_all_passages(spark):
    """More than 8,192 passages, of short texts too: cosines are those of a model that dense algebra makes of every one."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(1200)]
    odds = [1 / (k + 10) for k in range(1200)]
    items = [rng.choices(vocabulary, odds, k=16) for _ in range(40)]
    near = [[rng.choice(vocabulary) if k in (3, 8, 12) else w for k, w in enumerate(item)] for item in items]
    texts = near + [rng.choices(vocabulary, odds, k=rng.choice((9, 25, 40, 70, 90))) for _ in range(9000)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.cosine for r in lsa.leaks(docs, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect() if r.doc_id == r.item_id}

    number = {w: int(lsa._hash_text(w)[0]) % lsa.TERMS for w in vocabulary}
    used = sorted(set(number.values()))
    at = {w: used.index(n) for w, n in number.items()}
    blocks = [[t[k : k + 16] for k in range(0, len(t), 16)] for t in texts]
    seen = np.zeros(len(used))
    for block in (b for own in blocks for b in own):
        seen[list({at[w] for w in block})] += 1
    idf = np.log((sum(map(len, blocks)) + 2) / (seen + 1)) ** 2
    passages = []
    for own in blocks:
        n = -(-len(own) // 4)
        passages += [[w for j, b in enumerate(own) if j * n // len(own) == k for w in b] for k in range(n)]
    assert sum(map(len, passages)) == sum(map(len, texts)) and len(passages) > 8192

    def matrix(rows):
        out = np.zeros((len(rows), len(used)))
        for r, row in enumerate(rows):
            for w in row:
                out[r, at[w]] += idf[at[w]]
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    a, b = matrix(passages), matrix(items)
    gram = min(1, 8192 / len(passages)) * a.T @ a + lsa.ITEM_WEIGHT * b.T @ b
    start = np.random.default_rng(7).standard_normal((lsa.TERMS, lsa.RANK + lsa.EXTRA), np.float32)[used]
    q = np.linalg.qr(gram @ start)[0]
    values, vectors = np.linalg.eigh(q.T @ gram @ q)
    v = q @ vectors[:, -lsa.RANK :]
    x, y = matrix(near) @ v, b @ v
    want = (x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    assert len(got) >= 10 and got.keys() >= {d for d in range(40) if want[d] > lsa.LEAST_COSINE + 0.002}
    assert max(abs(got[d] - want[d]) for d in got) < 0.002


@pytest.mark.parametrize("what", ["docs", "bench", "both"])
def test_empty_and_odd_rows(spark, what):
    item = "what holds the roof of the old hall up on windy days. The seven oak pillars hold it"
    docs = spark.createDataFrame([(1, f"so {item} now"), (None, item), (2, None), (3, ""), (4, "..."), (1, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (5, item), (6, None), (7, "?"), (None, "another short thing entirely")], "item_id long, text string")
    got = lsa.leaks(docs.limit(0) if what != "bench" else docs, bench.limit(0) if what != "docs" else bench).collect()
    assert got == []
    assert {(r.doc_id, r.item_id) for r in lsa.leaks(docs, bench).collect()} == {(1, 5), (None, 5)}
    assert {r.doc_id for r in lsa.drop_leaks(docs, bench).collect()} == {1, 2, 3, 4}


def test_answers():
    assert lsa.answer_of("Q one? Answer: forty two.").strip() == "forty two."
    assert lsa.answer_of("First. The last one here. ").strip() == "The last one here"
    assert lsa.answer_of("no mark") == "no mark"
