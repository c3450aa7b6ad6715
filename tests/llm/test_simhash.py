import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import graph, queries, simhash

SF = "/root/testdata/sf0.001"


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least index reachable from each index."""
    distinct = sorted(set(prints))
    fps = np.array(distinct, np.uint64)
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            root[f] = f = root[root[f]]
        return f

    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3):
            a, b = find(f), find(distinct[i + 1 + j])
            root[a] = b
    least = {}
    for i, f in enumerate(prints):
        least.setdefault(find(f), i)
    return [least[find(f)] for f in prints]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in rows]
    want = [(r.doc_id, f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, brute_components(prints), strict=True)]
    assert sorted(tuple(r) for r in queries.op10_simhash(spark, SF).collect()) == want


@pytest.mark.parametrize("tile,sample", [(1 << 15, 1 << 18), (128, 1 << 18), (32, 100), (32, 1)])
def test_links_of_chains_and_crowds(spark, tile, sample):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(40)]
    prints = [c for c in centre for _ in range(3)]
    for c in centre:  # chains of steps within the radius, and steps just beyond it
        for step in (2, 3, 3, 4, 1):
            for b in rng.sample(range(64), step):
                c ^= 1 << b
            prints.append(c)
    crowd = rng.getrandbits(64)
    for _ in range(700):
        prints.append(crowd ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 1, 2, 3]))))
    prints += [0, 0, 2**64 - 1, rng.getrandbits(64)]
    rng.shuffle(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(s,) for s in set(signed)], "fp long"), tile, sample)
    assert found.count() <= (20 if tile > 1000 else 2000) * len(set(signed))
    roots = {r.node: r.root for r in graph.components(found).collect()}
    got = {}
    for i, s in enumerate(signed):
        got.setdefault(roots.get(s, s), []).append(i)
    want = {}
    for i, c in enumerate(brute_components(prints)):
        want.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_a_bucket_of_many_tiles(spark):
    """Ten times TILE members that share 40 bits: they come out as four rows each, not as pairs of tiles."""
    rng = np.random.default_rng(5)
    high = np.uint64(0xABCDE12345) << np.uint64(24)
    prints = np.unique(high | rng.integers(0, 1 << 22, 10 * 1024, dtype=np.uint64))
    tile = 1024
    run = simhash._linker(tile)
    mask = np.int64(-(1 << 24))
    batches = (simhash.pa.RecordBatch.from_pydict({"g": np.zeros(len(p), np.int64), "m": np.full(len(p), mask), "x": p.view(np.int64)}) for p in np.array_split(prints, 9))
    out = list(run(batches))
    assert max(b.num_rows for b in out) <= len(prints) and sum(b.num_rows for b in out) == 4 * len(prints)
    found = simhash.links(spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long"), tile)
    roots = {r.node: r.root for r in graph.components(found).collect()}
    want = brute_components(prints.tolist())
    got = {}
    for i, p in enumerate(prints.view(np.int64).tolist()):
        got.setdefault(roots.get(p, p), []).append(i)
    classes = {}
    for i, c in enumerate(want):
        classes.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(classes.values())


def test_keep_first_tells_texts_of_one_id_apart(spark):
    rows = [(5, "alone among all of these texts", "x"), (5, "a b c", "y"), (3, "a b c", "z"), (None, "a b c", "q"), (None, "only without an id", "r"), (3, "a b c", "again"), (9, None, ""), (8, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    left = sorted((tuple(r) for r in simhash.keep_first(docs).collect()), key=str)
    assert left == sorted([rows[0], rows[2], rows[5], rows[4], rows[7]], key=str)
    assert simhash.keep_first(docs.limit(0)).collect() == []


def test_edge_rows(spark):
    schema = "doc_id long, text string, fingerprint string, component_id long, fp string"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (5, "one two"), (None, "one two"), (None, "alone here"), (9, "É é"), (8, "é é")]
    docs = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], schema)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    want = []
    for (doc, _), p, c in zip(rows, prints, brute_components(prints), strict=True):
        same = [d for (d, _), q in zip(rows, brute_components(prints), strict=True) if q == c and d is not None]
        want.append((doc, f"{p:016x}", min(same, default=None)))
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (10, 11), (11, 10), (7, 7), (None, 1)] + [(i, i + 1) for i in range(100, 160)], "u long, v long")
    got = {(r.node, r.root) for r in graph.components(edges).collect()}
    assert got == {(n, 2) for n in range(2, 6)} | {(10, 10), (11, 10)} | {(n, 100) for n in range(100, 161)}
    assert graph.components(edges.filter(F.lit(False))).collect() == []
