import re
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import quality, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    n = len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_equal_brute_force(spark):
    schema = "doc_id long, text string, words string, lines string, n_words int"
    odd = [None, "", " \n ", "a b c a b c", "x x x x", "a b c d a b", "\x0b\x0cq w e \x1c", "é# é#\né# é#\n\n \n", "😀 <a> |\n|", "r\rs\r", "one two three " * 40, "A" * 20000]
    docs = spark.createDataFrame([(i, t, "c", "d", 1) for i, t in enumerate(odd)] + [(3, "a b c a b c", None, None, None), (None, "z", None, None, None)], schema)
    for table in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = quality.statistics(table).collect()
        got = sorted((tuple(r)[:6] + (r.base_failed,) for r in rows), key=str)
        assert got == sorted(((r.doc_id, *brute(r.text)) for r in table.collect()), key=str)


def test_query_keeps_good_and_rejects_bad(spark):
    rows = {r.doc_id: r for r in queries.op8_decision_list(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert not any(r.kept and r.base_failed for r in rows.values())
    judged = [(r.quality, rows[r.doc_id].kept) for r in labels if not rows[r.doc_id].base_failed]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_list_holds_on_rows_it_has_not_learned_from(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    rows = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), labels.filter(~held)).collect()}
    judged = [(r.quality, rows[r.doc_id].kept) for r in labels.filter(held).collect() if not rows[r.doc_id].base_failed]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert len(good) >= 100 and len(bad) >= 10
    assert sum(good) >= 0.95 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_learning_on_counts():
    cuts = {name: [1.0, 2.0] for name in quality.FEATURES}
    table = [((0, 2, 0, 0, 0), False, 0, 40), ((0, 2, 0, 0, 0), True, 0, 20), ((0, 1, 0, 0, 0), False, 10, 2), ((0, 0, 0, 0, 2), False, 1, 30), ((0, 0, 0, 0, 2), True, 0, 15)]
    table += [((0, 0, 0, 0, 0), False, 500, 1), ((0, 0, 0, 0, 0), True, 250, 0)]
    rules = quality.learn(cuts, table)
    assert [[(c.feature, c.above) for c in r][0] for r in rules] == [("symbol_ratio", True), ("upper_ratio", True)]
    assert quality.learn(cuts, []) == [] and quality.learn(cuts, [((0,) * 5, False, 9, 0)]) == []


def test_empty_tables_and_odd_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, None), (None, 0), (1, 1), (1, 0)], "doc_id long, quality int")
    assert quality.judge(docs, labels).collect() == []
    some = spark.createDataFrame([(1, "a b " * 60, 3), (2, "c", 4)], "doc_id long, text string, quality int")
    assert [(r.doc_id, r.kept) for r in quality.judge(some, labels.limit(0)).orderBy("doc_id").collect()] == [(1, False), (2, False)]
