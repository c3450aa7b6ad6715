"""WARC fixity audit with Merkle trees over ordered offset ranges.

A segment (a WARC file) is a run of records at byte offsets. A leaf of its tree covers a
range of RANGE bytes and hashes, in order, the offsets, lengths and digests of the records
that begin there; an inner node hashes its FANOUT children. Two replicas are compared from
the roots: a level's nodes are joined only below parents that differ, and records only in
ranges whose leaves differ. There, records are told apart by their ids, so that those that
merely lie elsewhere, after a gap, aren't taken for changed ones. All of it is grouped aggregation and equi-join on
(segment, index), over rows without payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.shared import durable

#: Bytes of a leaf's range, children of a node, page_ids of a segment, and pages that it holds at most if page_ids repeat.
RANGE, FANOUT, SEGMENT_PAGES, MOST_PAGES = 1 << 16, 16, 1024, 1 << 14
#: How a WARC record begins and ends, and its lines: fixed values.
_BEGIN, _END, _LINE = "WARC/1.1\r\n", "\r\n\r\n", "\r\n"
_KEY = ["segment", "idx"]


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """A page as the text of a WARC resource record; nulls are empty."""
    body, url, record_id = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit("")), F.coalesce(record_id.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), record_id, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def page_records(pages: DataFrame, body: Column | None = None) -> DataFrame:
    """(segment, record_id, length, digest, record) of pages (page_id, url, html), with another ``body`` than html if one is given.

    Pages are packed SEGMENT_PAGES page_ids to a segment. Pages without a page_id are
    spread over segments below zero by their URL, and page_ids that repeat so often that a
    segment would hold more than MOST_PAGES pages over several segments.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html") if body is None else body)
    spread = F.pmod(F.xxhash64("url"), F.lit(1 << 12))
    segment = F.coalesce(F.floor(F.col("page_id") / SEGMENT_PAGES), -1 - spread).cast("long")
    rows = pages.select(segment.alias("segment"), F.col("page_id").cast("long").alias("record_id"), F.xxhash64("url").alias("by"), record.alias("record"))
    full = durable(pages.groupBy(segment.alias("full")).agg(F.count("*").alias("n")).filter(F.col("n") > MOST_PAGES))
    if full.limit(1).count():
        part = F.pmod(F.col("by"), F.ceil(F.col("n") / MOST_PAGES).cast("long"))
        rows = rows.join(full, F.col("segment") == F.col("full"), "left").withColumn("segment", F.col("segment") + F.coalesce(part, F.lit(0)) * F.lit(1 << 40))
    return rows.select("segment", "record_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), "record")


def pack(records: DataFrame) -> DataFrame:
    """(segment, offset, length, record_id, digest): ``records`` with the offset of each in its segment, in order of record_id, then digest."""
    before = Window.partitionBy("segment").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.select("segment", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "record_id", "digest")


def write_segments(pages: DataFrame, path: str) -> str:
    """Writes ``pages`` as WARC files, one in each folder segment=N below ``path``, and returns ``path``."""
    value = F.expr(f"substr(record, 1, length(record) - {len(_LINE)})").alias("value")  # the writer adds the last line end
    rows = page_records(pages).repartition("segment").sortWithinPartitions("segment", "record_id", "digest")
    rows.select("segment", value).write.mode("overwrite").partitionBy("segment").option("lineSep", _LINE).text(path)
    return path


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, offset, length, record_id, digest) of the records of the WARC files that ``write_segments`` wrote.

    Files are split at the marks between records, so that tasks share a large one; a
    payload with such a mark in it counts as two records, the second without an id, in any
    replica alike.
    """
    raw = spark.read.option("lineSep", _END + _BEGIN).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")]
    rows = raw.select("segment", *place, "value").withColumn("value", F.when(F.startswith("value", F.lit(_BEGIN)), F.expr(f"substr(value, {len(_BEGIN) + 1})")).otherwise(F.col("value")))
    inner = F.regexp_replace("value", f"{_END}$", "")
    whole = lambda v: F.sha2(F.concat(F.lit(_BEGIN), v, F.lit(_END)), 256)
    record = F.regexp_extract("value", r"^(?:[^\r\n]+\r\n)*?WARC-Record-ID: <urn:page:(-?[0-9]+)>\r\n", 1)
    facts = rows.select("segment", "file", "block", "nth", F.octet_length("value").alias("size"), whole(F.col("value")).alias("digest"), whole(inner).alias("last_digest"), F.nullif(record, F.lit("")).cast("long").alias("record_id"))
    order = Window.partitionBy("segment", "file").orderBy("block", "nth")
    ended = facts.withColumn("last", F.lead("nth").over(order).isNull())  # the last record still has its end
    frame = len(_BEGIN) + len(_END)
    length = (F.col("size") + F.when(F.col("last"), frame - len(_END)).otherwise(frame)).cast("long")
    sized = ended.select("segment", "file", "block", "nth", length.alias("length"), F.when(F.col("last"), F.col("last_digest")).otherwise(F.col("digest")).alias("digest"), "record_id")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    return sized.select(F.col("segment").cast("long"), offset, "length", "record_id", "digest")


def _hash(parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", parts), 256)


def leaves(records: DataFrame, span: int = RANGE) -> DataFrame:
    """(segment, idx, hash) of each range of bytes that a record of (segment, offset, length, digest) begins in."""
    item = F.struct("offset", F.concat_ws(" ", "offset", "length", "digest").alias("line"))
    ranged = records.groupBy("segment", F.floor(F.col("offset") / span).alias("idx"))
    return ranged.agg(_hash(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"])).alias("hash"))  # a range holds few records


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    item = F.struct("idx", F.concat_ws(" ", "idx", "hash").alias("line"))
    return nodes.groupBy("segment", F.floor(F.col("idx") / fanout).alias("idx")).agg(_hash(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"])).alias("hash"))


def tree(records: DataFrame, depth: int, span: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of nodes from the leaves up to the roots, ``depth`` levels above."""
    levels = [durable(leaves(records, span))]
    for _ in range(depth):
        levels.append(durable(parents(levels[-1], fanout)))
    return levels


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes (segment, idx) that one side lacks or whose hashes differ."""
    joined = ours.join(theirs.withColumnRenamed("hash", "other"), _KEY, "full")
    return joined.filter(~F.col("hash").eqNullSafe(F.col("other"))).select(*_KEY)


def _below(nodes: DataFrame, marked: DataFrame, fanout: int) -> DataFrame:
    """The children, among ``nodes``, of marked parents."""
    up = marked.select(F.col("segment").alias("_segment"), F.col("idx").alias("_idx"))
    return nodes.join(up, (F.col("segment") == F.col("_segment")) & (F.floor(F.col("idx") / fanout) == F.col("_idx")), "left_semi")


def _paired(a: DataFrame, b: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Both sides' records with the same ``key``, one with one, in ``order``; either side may be null."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    left, right = (side.withColumn("nth", nth).withColumn("here", F.lit(True)).alias(name) for side, name in ((a, "a"), (b, "b")))
    same = F.col("a.nth") == F.col("b.nth")
    for c in key:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return left.join(right, same, "full")


_RECORD = ["segment", "offset", "length", "record_id", "digest"]


def audit(ours: DataFrame, theirs: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """(segment, offset, length, record_id, status, expected, found, found_offset) of each record in which the replicas differ.

    Both tables hold (segment, offset, length, record_id, digest); other columns aren't
    read. Records of one segment and record_id are paired, equal ones first, then those of
    one digest: these are moved. Of the others, in order of offset and digest, pairs are
    changed, and what is left is missing (only ours) or extra (only theirs). Null ids are
    equal, null digests count as empty, and records without a segment or offset don't
    count. ``offset`` and ``length`` are ours, but for extra ones. Equal or empty replicas
    give no rows.
    """
    def slim(side: DataFrame) -> DataFrame:
        columns = [F.col("segment").cast("long"), F.col("offset").cast("long"), F.col("length").cast("long"), F.col("record_id").cast("long"), F.coalesce("digest", F.lit("")).alias("digest")]
        return durable(side.select(*_RECORD).filter("segment is not null and offset is not null").select(*columns))

    ours, theirs = slim(ours), slim(theirs)
    furthest = ours.select("offset").unionByName(theirs.select("offset")).agg(F.max("offset")).first()[0] or 0
    depth, reach = 0, span
    while reach <= furthest:
        depth, reach = depth + 1, reach * fanout
    own, other = tree(ours, depth, span, fanout), tree(theirs, depth, span, fanout)
    marked = durable(_differing(own[-1], other[-1]))
    for level in range(depth - 1, -1, -1):
        marked = durable(_differing(_below(own[level], marked, fanout), _below(other[level], marked, fanout)))

    def suspects(side: DataFrame) -> DataFrame:
        up = marked.select(F.col("segment").alias("_segment"), F.col("idx").alias("_idx"))
        return side.join(up, (F.col("segment") == F.col("_segment")) & (F.floor(F.col("offset") / span) == F.col("_idx")), "left_semi")

    same = durable(_flat(_paired(suspects(ours), suspects(theirs), _RECORD, ["offset"])))
    moved = durable(_flat(_paired(_side(same, "a"), _side(same, "b"), ["segment", "record_id", "length", "digest"], ["offset"])))
    rest = _flat(_paired(_side(moved, "a"), _side(moved, "b"), ["segment", "record_id"], ["offset", "digest"]))
    status = F.when(~F.col("b_here"), "missing").when(~F.col("a_here"), "extra").otherwise("changed")
    both = moved.filter("a_here and b_here").withColumn("status", F.lit("moved")).unionByName(rest.withColumn("status", status))
    shown = [F.when(F.col("a_here"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in _RECORD[:4]]
    return both.select(*shown, "status", F.col("a_digest").alias("expected"), F.col("b_digest").alias("found"), F.col("b_offset").alias("found_offset"))


def _flat(paired: DataFrame) -> DataFrame:
    return paired.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in _RECORD], *[F.coalesce(F.col(f"{s}.here"), F.lit(False)).alias(f"{s}_here") for s in "ab"])


def _side(pairs: DataFrame, side: str) -> DataFrame:
    """The records of one side that have no partner."""
    return pairs.filter(f"a_here <> b_here and {side}_here").select(*[F.col(f"{side}_{c}").alias(c) for c in _RECORD])
