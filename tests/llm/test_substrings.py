import os
import random
import subprocess
import sys

import pyarrow as pa

from plumbline.llm import names, queries, substrings
from tests.llm.oracle import compare

SF = "/root/testdata/sf0.001"


def brute(rows, least_run=substrings.RUN_WORDS, least_line=substrings.LINE_WORDS):
    """Removed spans of (doc_id, text) rows, found unit by unit in order of doc_id."""
    terms = "\n.!?,;:"
    seen, out = {}, []
    for doc, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        cuts, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] not in terms:
                j += 1
            while j < len(text) and text[j] in terms:
                j += 1
            cuts.append((i, j))
            i = j
        marked, fresh_line = [], True
        for a, b in cuts:
            low = "".join(c.lower() if c.isascii() else c for c in text[a:b])
            form = b" ".join(low.encode().split()).decode()
            n = len(form.split(" ")) if form else 0
            form = form.rstrip(".!?,;:")
            ends = "\n" in text[a:b] or b == len(text)
            if form:
                marked.append([a, b, n, fresh_line, ends, seen.get(form)])
                seen.setdefault(form, doc)
                fresh_line = ends
            elif ends:  # a stretch without words ends the line of the words before it
                fresh_line = True
                if marked:
                    marked[-1][4] = True
        runs, run = [], []
        for unit in [*marked, (0, 0, 0, 0, 0, None)]:
            if unit[5] is None:
                runs += [run] if run else []
                run = []
            else:
                run.append(unit)
        for run in runs:
            if sum(u[2] for u in run) < least_run:
                while run and not run[0][3]:
                    run = run[1:]
                while run and not run[-1][4]:
                    run = run[:-1]
                if sum(u[2] for u in run) < least_line:
                    continue
            out.append((doc, run[0][0], run[-1][1], sum(u[2] for u in run), run[0][5]))
    return sorted(out)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op4_line_dedup(spark, SF).collect())
    assert got and got == brute(rows)


def test_planted_passages_inside_lines(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))

    def prose(n):
        out = []
        while len(out) < n:
            k = rng.randint(3, 18)
            out += [word() + ("," if rng.random() < 0.15 else "") for _ in range(k)]
            out[-1] += rng.choice([".", ".", ".\n", "!"])
        return " ".join(out)

    passage = prose(60)
    rows = [(i, f"{prose(150)} {word()} {passage} {word()} {prose(90)}" if i % 5 == 0 else prose(200)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.removed_spans(docs).collect()
    assert {r.doc_id for r in got} == {i for i in range(5, 60, 5)}
    assert all(r.first_doc_id == 0 and r.n_words >= 15 for r in got)
    assert sorted(tuple(r) for r in got) == brute(rows)
    left = {r.doc_id: r.text for r in substrings.remove_repeats(docs).collect()}
    for i, text in rows:
        spans = sorted((r.start, r.end) for r in got if r.doc_id == i)
        for a, b in reversed(spans):
            text = text[:a] + text[b:]
        assert left[i] == text


def test_edge_rows(spark):
    schema = "doc_id long, text string, n_chars long, mark string, h int, spans string"
    line = "this line has six words here"
    rows = [(1, f"{line}\nq\n"), (2, f"{line.upper()}\nother"), (2, f"{line}\nyet another"), (3, None), (4, ""), (None, line), (5, f"a {line}"), (6, f"{line}\n{line}"), (7, f"\n\n{line}.\n")]
    docs = spark.createDataFrame([(*r, 1, "m", 2, "s") for r in rows], schema)
    got = sorted(tuple(r) for r in substrings.removed_spans(docs).collect())
    assert got == [(2, 0, 29, 6, 1), (2, 0, 29, 6, 1), (6, 0, 57, 12, 1), (7, 2, 32, 6, 1)]
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == sorted(
        [(1, f"{line}\nq\n", 31), (2, "other", 5), (2, "yet another", 11), (3, None, None), (4, "", 0), (None, line, 28), (5, f"a {line}", 30), (6, "", 0), (7, "\n\n", 2)], key=str
    )
    assert substrings.remove_repeats(docs.limit(0)).collect() == []


def test_units_without_words_neither_cut_nor_hide_line_ends(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    lines = [" ".join(word() for _ in range(10)) for _ in range(6)]
    for k, cut in enumerate([".\r\n", ". \n", ". . .", "!\n \n\t\n"]):
        passage = cut.join(lines) + cut
        rows = [(0, passage), (1, passage), (2, f"{word()} {word()}\n{passage}{word()} {word()}"), (3, f"{word()}.\r\n{lines[0]}.\r\n{word()}")]
        got = sorted(tuple(r) for r in substrings.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert [(r[0], r[3], r[4]) for r in got] == [(1, 60, 0), (2, 60, 0), (3, 10, 0)], cut
        for doc, start, end, _, _ in got:
            removed = rows[doc][1][start:end]
            assert removed.startswith(lines[0]) and removed.rstrip(" \t\r\n.!").endswith(lines[0 if doc == 3 else -1])


def test_sql_and_brute_force_on_odd_texts(spark, tmp_path):
    rng = random.Random(6)
    parts = ["the same words stand here again", "alpha beta gamma delta epsilon zeta", "one two", " ", ".", " . . ", "\r\n", "\n", ", ", "!\n", "漢字。", "かな、", "\n\n", "ÀÉ ö", "AbC dEf"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/t")
    (part,) = (tmp_path / "t").glob("part-*.parquet")
    part.rename(tmp_path / "documents.parquet")
    assert compare(substrings.removed_spans(docs), queries.OP4_SQL, tmp_path) > 100
    plain = [(i, t) for i, t in rows if t.isascii()]
    assert sorted(tuple(r) for r in substrings.removed_spans(spark.createDataFrame(plain, docs.schema)).collect()) == brute(plain)


def test_a_very_long_unit_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT_KEYS", 2)
    unit = " ".join(f"w{i % 977}" for i in range(20_000))
    hot = "this clause is in each and every one of all these very many documents of this table, "
    rows = [(0, unit), (1, unit), *((i, f"{hot}\nown{i} words") for i in range(2, 3000))]
    got = sorted(tuple(r) for r in substrings.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and got[0] == (1, 0, len(unit), 20_000, 0) and len(got) == 2998


def test_scripts_without_blanks(spark):
    rng = random.Random(4)
    for low, high, mark in ((0x4E00, 0x9FA5, "。"), (0x3041, 0x3096, "、"), (0x0E01, 0x0E2E, "\n")):
        sentence = lambda n: "".join(chr(rng.randint(low, high)) for _ in range(n)) + mark  # noqa: E731,B023
        passage = "".join(sentence(14) for _ in range(4))
        rows = [(0, passage), (1, passage), (2, sentence(9) + passage + sentence(9)), (3, sentence(60))]
        got = sorted(tuple(r) for r in substrings.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == [(1, 0, 60, 28, 0), (2, 10, 70, 28, 0)]


def test_workers_return_small_batches():
    """What a worker holds doesn't grow with the rows of a batch of texts."""
    texts = [" ".join(f"word{i} of text{k}," for i in range(40)) for k in range(6000)]
    batch = pa.record_batch({"doc_id": pa.array(range(6000), pa.int64()), "mark": pa.array(range(6000), pa.int64()), "text": pa.array(texts)})
    found = list(substrings._unit_rows(iter([batch])))
    assert sum(b.num_rows for b in found) == 6000 * 40 and max(b.num_rows for b in found) <= substrings.OUT_UNITS + 40
    spans = pa.array([[{"start": 0, "end": 2}] if k % 2 else None for k in range(6000)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    out = list(substrings._without("spans")(iter([batch.append_column("spans", spans)])))
    assert max(b.num_rows for b in out) <= substrings.OUT_TEXTS
    assert [t for b in out for t in b.column("text").to_pylist()] == [t[2:] if k % 2 else t for k, t in enumerate(texts)]


def test_workers_hand_memory_back():
    code = """
import re
import numpy as np, pyarrow as pa
from plumbline.llm import vec

def held():
    return int(re.search(r"Anonymous: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def run(batches):
    for batch in batches:
        columns = [pa.array(np.arange(1 << 17)) for _ in range(200)]
        pieces = [np.ones(8000) for _ in range(5000)]
        last = pieces[-1]
        del pieces, columns
        yield batch

before = held()
for _ in vec.lean(run)(iter([pa.record_batch({"x": [1]})] * 2)):
    pass
print(held() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120, check=True)
    assert float(found.stdout) < 30
