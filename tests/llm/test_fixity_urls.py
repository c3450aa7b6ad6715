import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import fixity, queries, urlfilter
from tests.llm.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op1_merkle_fixity", "op4_line_dedup", "op6_url_list_join"])
def test_query_equals_its_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) > 0


def audit_by_hand(ours, theirs):
    out = []
    for key in {(r[0], r[3]) for r in ours + theirs}:
        a, b = ([r for r in side if (r[0], r[3]) == key] for side in (ours, theirs))
        for r in list(a):  # equal records
            if r in b:
                a.remove(r)
                b.remove(r)
        for r in sorted(a, key=lambda r: (r[4], r[2], r[1])):
            found = sorted(x for x in b if (x[2], x[4]) == (r[2], r[4]))
            if found:
                out.append((*r[:4], "moved", r[4], r[4], found[0][1]))
                a.remove(r)
                b.remove(found[0])
        a, b = (sorted(side, key=lambda r: (r[1], r[4])) for side in (a, b))
        for i in range(max(len(a), len(b))):
            x, y = (a[i] if i < len(a) else None), (b[i] if i < len(b) else None)
            out.append((*(x or y)[:4], "missing" if y is None else "extra" if x is None else "changed", x and x[4], y and y[4], y and y[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("span,fanout", [(64, 2), (256, 4), (1 << 16, 16)])
def test_audit_equals_a_record_by_record_comparison(spark, span, fanout):
    rng = random.Random(span)
    ours = []
    for segment in range(6):
        at = 0
        for i in range(rng.randint(0, 60)):
            ours.append((segment, at, n := rng.randint(1, 90), i, f"{rng.getrandbits(32):08x}"))
            at += n
    theirs, lost = [], {}
    for r in ours:  # what follows a lost record lies elsewhere
        if rng.random() < 0.03:
            lost[r[0]] = lost.get(r[0], 0) + r[2]
        else:
            theirs.append((r[0], r[1] - lost.get(r[0], 0) * (r[0] % 2), *r[2:]))
    ours += [(2, 10_000, 7, 5, "twice"), (2, 10_007, 7, 5, "twice"), (2, 10_014, 7, None, "x")]
    theirs += [(2, 9_000, 7, 5, "twice"), (2, 10_014, 7, None, "y")]
    theirs = [(*r[:4], "bad") if rng.random() < 0.05 else r for r in theirs] + [(9, 0, 5, 1, "new"), (9, 0, 5, 1, "new"), (0, 3, 1, 77, "between")]
    schema = "segment long, offset long, length long, record_id long, digest string"
    a, b = spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema)
    got = sorted((tuple(r) for r in fixity.audit(a, b.withColumn("status", F.lit(1)).withColumn("hash", F.lit(2)), span, fanout).collect()), key=str)
    assert got == audit_by_hand(ours, theirs)
    assert fixity.audit(a, a, span, fanout).collect() == []
    assert fixity.audit(a.limit(0), a.limit(0), span, fanout).collect() == []


def test_pages_without_id_url_or_body(spark):
    rows = [(None, "u", "h"), (None, "u", "h"), (1, None, None), (1, "u", ""), (5000, "é", "ß" * 10)]
    packed = fixity.pack(fixity.page_records(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int"))).collect()
    assert len(packed) == 5
    assert sorted((r.segment, r.record_id) for r in packed if r.record_id is not None) == [(0, 1), (0, 1), (4, 5000)]
    assert {r.segment < 0 for r in packed if r.record_id is None} == {True}
    (last,) = [r for r in packed if r.record_id == 5000]
    assert last.length == len(("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:5000>\r\nWARC-Target-URI: é\r\nContent-Length: 20\r\n\r\n" + "ß" * 10 + "\r\n\r\n").encode())


def test_a_page_id_of_very_many_pages_and_a_very_long_page(spark, monkeypatch):
    monkeypatch.setattr(fixity, "MOST_PAGES", 100)
    pages = spark.range(1000).selectExpr("7L as page_id", "concat('http://h/', id) as url", "if(id = 3, repeat('long ', 1000000), 'x') as html")
    packed = fixity.pack(fixity.page_records(pages))
    sizes = [r["count"] for r in packed.groupBy("segment").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) > 5 and max(sizes) < 200
    assert fixity.audit(packed, packed).collect() == []


@pytest.mark.parametrize("split", [1 << 27, 3000])
def test_warc_files_are_read_as_they_were_written(spark, tmp_path, split):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i % 50)}\r\n\r\nText {i}\n") for i in range(3000)] + [(4000, None, None), (4001, "u", "\r\n\r\n"), (None, "n", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = fixity.write_segments(pages, f"file://{tmp_path}/warc")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = sorted((tuple(r) for r in fixity.read_segments(spark, path).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = fixity.pack(fixity.page_records(pages)).select("segment", "offset", "length", "record_id", "digest")
    assert got == sorted((tuple(r) for r in want.collect()), key=str)
    (first,) = (tmp_path / "warc" / "segment=0").glob("part-*")
    raw = first.read_bytes()
    assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC/1.1\r\n") == 1024 and len(raw) == sum(r[2] for r in got if r[0] == 0)


def test_hosts(spark):
    urls = ["http://A.b.c./x", "http://[::1]:80/", "https://[2001:DB8::1]/p", "http://u:p@h.org:8080?q", "http://.", "mailto:x", None, "http://h:"]
    got = [r.h for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(urlfilter.host_of(F.col("u")).alias("h")).collect()]
    assert got == ["a.b.c", "[::1]", "[2001:db8::1]", "h.org", None, None, None, "h"]


def test_a_parent_of_very_many_hosts(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "HOT_KEYS", 2)
    captures = spark.range(4000).selectExpr("id as capture_id", "concat('http://s', id, if(id % 3 = 0, '.blog.example', '.other.example'), '/') as url", "date'2024-01-10' as fetched")
    events = spark.createDataFrame([("blog.example", "add", dt.date(2024, 1, 1)), ("s1.other.example", "add", dt.date(2024, 1, 5))], "domain string, action string, day date")
    got = urlfilter.apply(captures, events).filter("blocked").collect()
    assert {r.capture_id for r in got} == {i for i in range(0, 4000, 3)} | {1}


def test_list_join_equals_replaying_the_log(spark):
    rng = random.Random(2)
    day = lambda n: dt.date(2023, 11, 20) + dt.timedelta(n)
    names = ["a.b.c", "b.c", "x.b.c", "c", "q.z", "z"]
    log = [(rng.choice([*names, None]), rng.choice(["add", "remove", "add", "note", None]), day(rng.randint(0, 200)), "x") for _ in range(150)] + [("B.C", "add", None, "x")]
    captures = [(i, rng.choice(["http://a.b.c/x", "https://X.b.c:80?q", "http://u@q.z#f", "ftp://c/", "nonsense", None, "http://other.org"]), day(rng.randint(-10, 230)) if i % 11 else None, True) for i in range(300)]
    frame = spark.createDataFrame(captures + captures[:5], "capture_id long, url string, fetched date, blocked boolean")
    events = spark.createDataFrame(log, "domain string, action string, day date, rule string")
    hosts = {"http://a.b.c/x": "a.b.c", "https://X.b.c:80?q": "x.b.c", "http://u@q.z#f": "q.z", "ftp://c/": "c", "http://other.org": "other.org"}

    def listed(domain, on):
        state, since = False, None
        for d in sorted({e[2] for e in log if e[0] == domain and e[1] in ("add", "remove") and e[2] and e[2] <= on}):
            now = any(e[:3] == (domain, "add", d) for e in log)
            state, since = now, (since if now and state else d)
        return since if state else None

    want = []
    for i, url, on, _ in captures + captures[:5]:
        host = hosts.get(url)
        found = []
        if host and on:
            labels = host.split(".")
            for k in range(max(1, len(labels) - 1)):
                domain = ".".join(labels[k:])
                if since := listed(domain, on):
                    found.append((domain, since))
        want.append((i, host, on, bool(found), len(found), found[0][0] if found else None, found[0][1] if found else None))
    assert sorted(tuple(r) for r in urlfilter.apply(frame, events).collect()) == sorted(want)
    assert not any(r.blocked for r in urlfilter.apply(frame, events.limit(0)).collect())
    assert urlfilter.apply(frame.limit(0), events).collect() == []
