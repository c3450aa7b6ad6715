"""The queries of this subpackage, each its operator over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, fixity, langid, pipeline, quality, simhash, substrings, tokens, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC segments against a replica with planted damage.

    Of every 97 records one has its first character replaced, of every 193 one is missing,
    and of every 41 segments one ends halfway. The replica has offsets of its own: what
    follows a missing record lies elsewhere. Nulls and repeated ids: see ``fixity.audit``.
    """
    gone = (F.pmod("page_id", F.lit(193)) == 7) | ((F.pmod(F.floor(F.col("page_id") / fixity.SEGMENT_PAGES), F.lit(41)) == 3) & (F.pmod("page_id", F.lit(fixity.SEGMENT_PAGES)) >= 512))
    rotten = F.pmod("page_id", F.lit(97)) == 13
    body = F.coalesce("html", F.lit(""))
    pages = _table(spark, sf_dir, "pages")
    ours = fixity.pack(fixity.page_records(pages))
    replica = F.when(rotten, F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(body)
    theirs = fixity.pack(fixity.page_records(pages.filter(~F.coalesce(gone, F.lit(False))), replica))
    return fixity.audit(ours, theirs).withColumnRenamed("record_id", "page_id")


OP1_SQL = """
WITH bodies AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         CASE WHEN page_id % 193 = 7 OR ((page_id // 1024) % 41 = 3 AND page_id % 1024 >= 512) THEN NULL
              WHEN page_id % 97 = 13 THEN '#' || substr(html, 2) ELSE coalesce(html, '') END AS other
  FROM pages),
records AS (SELECT page_id, 'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Target-URI: ' || url || '\r\nContent-Length: ' AS head, html, other FROM bodies),
texts AS (
  SELECT page_id, replace(head || strlen(html) || '\r\n\r\n', '\r\n', chr(13) || chr(10)) || html || repeat(chr(13) || chr(10), 2) AS own,
         replace(head || strlen(other) || '\r\n\r\n', '\r\n', chr(13) || chr(10)) || other || repeat(chr(13) || chr(10), 2) AS theirs FROM records),
digests AS (SELECT page_id // 1024 AS segment, page_id, CAST(strlen(own) AS BIGINT) AS length, sha256(own) AS expected, CAST(strlen(theirs) AS BIGINT) AS found_length, sha256(theirs) AS found FROM texts),
packed AS (
  SELECT *, CAST(coalesce(sum(length) OVER w, 0) AS BIGINT) AS "offset", CASE WHEN found IS NOT NULL THEN CAST(coalesce(sum(found_length) OVER w, 0) AS BIGINT) END AS found_offset
  FROM digests WINDOW w AS (PARTITION BY segment ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT segment, "offset", length, page_id, CASE WHEN found IS NULL THEN 'missing' WHEN found <> expected THEN 'changed' ELSE 'moved' END AS status, expected, found, found_offset
FROM packed WHERE found IS DISTINCT FROM expected OR found_offset <> "offset"
"""


def op2_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_id, language, posterior, text_language, n_grams, kept) of all documents, and of all pages with their markup and addresses; one of the ids is null.

    Null texts, ids and repeated rows: see ``langid.identify``.
    """
    none = F.lit(None).cast("long")
    docs = langid.documents_as_rows(_table(spark, sf_dir, "documents")).withColumn("page_id", none)
    pages = langid.pages_as_rows(_table(spark, sf_dir, "pages")).withColumn("page_id", F.col("doc_id"))
    rows = docs.unionByName(pages).withColumn("id", F.col("doc_id")).withColumn("doc_id", F.when(F.col("page_id").isNull(), F.col("doc_id")))
    model = langid.fit(rows.withColumn("doc_id", F.col("id")))
    return langid.identify(rows, model, keep=("doc_id", "page_id"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from their token files; null texts, ids and repeated rows: see ``tokens.write_tokens``."""
    return tokens.token_digests(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id) of all spans of documents that repeat earlier text; null texts, ids and repeated rows: see ``substrings.repeated_spans``."""
    return substrings.removed_spans(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '[^\n.!?,;:。！？，；：、｡､]*[\n.!?,;:。！？，；：、｡､]+|[^\n.!?,;:。！？，；：、｡､]+') AS units FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''),
numbered AS (SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) AS n, len(units) AS last FROM cut),
placed AS (
  SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY n) AS "end", contains(unit, chr(10)) OR n = last AS ends,
         rtrim(unit, '.!?,;:。！？，；：、｡､ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
         list_filter(string_split_regex(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM numbered),
counted AS (
  SELECT *, sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY n) - ends::INT AS line, rtrim(array_to_string(words, ' '), '.!?,;:。！？，；：、｡､') AS form,
         regexp_replace(core, '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]', ' ', 'g') AS blanked FROM placed),
unspaced AS (SELECT *, length(list_aggregate(list_transform(range(0, length(core)), lambda i: CASE WHEN substr(core, i + 1, 1) <> substr(blanked, i + 1, 1) THEN 'x' ELSE '' END), 'string_agg', '')) AS strange FROM counted WHERE core <> blanked),
formed AS (
  SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.n) AS n, c."end" - length(c.unit) AS start, c."end", c.form,
         coalesce(c.line > lag(c.line) OVER (PARTITION BY c.doc_id ORDER BY c.n), true) AS begins, coalesce(c.line < lead(c.line) OVER (PARTITION BY c.doc_id ORDER BY c.n), true) AS ends,
         CASE WHEN u.strange > 0 THEN len(list_filter(string_split_regex(c.blanked, '[\x20\x09-\x0D]+'), lambda w: w <> '')) + (u.strange + 1) // 2 ELSE len(c.words) END AS k
  FROM counted c LEFT JOIN unspaced u ON u.doc_id = c.doc_id AND u.n = c.n WHERE c.form <> ''),
ranked AS (
  SELECT *, min(doc_id) OVER (PARTITION BY form) AS first_doc_id, row_number() OVER (PARTITION BY doc_id, form ORDER BY n) AS nth FROM formed),
marked AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM ranked WHERE doc_id > first_doc_id OR nth > 1),
runs AS (SELECT *, sum(k) OVER w AS total, min(n) FILTER (begins) OVER w AS lo, max(n) FILTER (ends) OVER w AS hi FROM marked WINDOW w AS (PARTITION BY doc_id, island)),
chosen AS (SELECT * FROM runs WHERE total >= 15 OR n BETWEEN lo AND hi)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end", CAST(sum(k) AS INTEGER) AS n_words, arg_min(first_doc_id, n) AS first_doc_id
FROM chosen GROUP BY doc_id, island HAVING sum(k) >= 5
"""


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of all documents; null texts, ids and repeated rows: see ``toxicity.score`` and ``toxicity.fit``."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_url_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with fetch days over 2024, against a list of entries on the hosts' own domains.

    The pages have neither fetch days nor a list, so both are derived: the day from the
    page_id, and, for a part of the hosts and of the domains above them, entries that add,
    remove and add again on days that depend on the name.
    """
    pages = _table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("fetched"))
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    domains = hosts.select(F.explode(F.array("host", F.regexp_replace("host", r"^(www|m|blog)\.", ""))).alias("domain")).distinct()
    n = F.length("domain") * 13 + F.ascii("domain") * 7 + F.ascii(F.substring("domain", 5, 1))
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(n * 5, F.lit(250)).cast("int"))
    listed = domains.withColumn("n", n).filter("n % 3 <> 0").select("domain", "n", start.alias("start"))
    events = listed.select("domain", F.explode(F.expr(
        "filter(array(struct('add' as action, start as day), struct('add' as action, date_add(start, 9) as day), struct('remove' as action, date_add(start, 40) as day),"
        " struct(if(n % 2 = 0, 'add', null) as action, date_add(start, 90) as day)), e -> e.action is not null)"
    )).alias("e")).select("domain", "e.action", "e.day")
    out = urlfilter.apply(captures, events).withColumnRenamed("capture_id", "page_id")
    return out.withColumn("fetched", F.col("fetched").cast("string")).withColumn("listed_since", F.col("listed_since").cast("string"))


OP6_SQL = r"""
WITH captures AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)', 1)), '\.$', ''), '') AS host,
         DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS fetched FROM pages),
domains AS (
  SELECT host AS domain FROM captures WHERE host IS NOT NULL
  UNION SELECT regexp_replace(host, '^(www|m|blog)\.', '') FROM captures WHERE host IS NOT NULL),
numbered AS (SELECT domain, length(domain) * 13 + ascii(domain) * 7 + ascii(substr(domain, 5, 1)) AS n FROM domains),
starts AS (SELECT domain, n, DATE '2024-01-01' + CAST((n * 5) % 250 AS INTEGER) AS start FROM numbered WHERE n % 3 <> 0),
valid AS (
  SELECT domain, start AS valid_from, start + 40 AS valid_to FROM starts
  UNION ALL SELECT domain, start + 90, NULL FROM starts WHERE n % 2 = 0),
active AS (
  SELECT c.page_id, v.domain, v.valid_from, row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.domain) DESC, v.domain DESC) AS nth,
         count(*) OVER (PARTITION BY c.page_id) AS n
  FROM captures c JOIN valid v ON (c.host = v.domain OR ends_with(c.host, '.' || v.domain)) AND c.fetched >= v.valid_from AND (v.valid_to IS NULL OR c.fetched < v.valid_to))
SELECT c.page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, a.n IS NOT NULL AS blocked, coalesce(a.n, 0) AS n_entries, a.domain AS rule, CAST(a.valid_from AS VARCHAR) AS listed_since
FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND a.nth = 1
"""


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of all documents; null texts, ids and repeated rows: see ``bpe.encode_digests``."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and verdicts of all documents; null texts, ids, labels and repeated rows: see ``quality.judge``."""
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_ratio, answer_ratio, first_word) of all documents that hold a benchmark item; null texts, ids and repeated rows: see ``decontaminate.leaks``."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of all documents; null texts, ids and repeated rows: see ``simhash.near_duplicates``."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_fixity": op1_merkle_fixity,
        "op2_language_fusion": op2_language_fusion,
        "op3_token_files": op3_token_files,
        "op4_line_dedup": op4_line_dedup,
        "op5_crf_toxicity": op5_crf_toxicity,
        "op6_url_list_join": op6_url_list_join,
        "op7_bpe_chunks": op7_bpe_chunks,
        "op8_decision_list": op8_decision_list,
        "op9_latent_leaks": op9_latent_leaks,
        "op10_simhash": op10_simhash,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_merkle_fixity": OP1_SQL, "op4_line_dedup": OP4_SQL, "op6_url_list_join": OP6_SQL}
