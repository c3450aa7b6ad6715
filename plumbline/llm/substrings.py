"""Substring dedup by hashing units of lines: the earliest occurrence stays, the rest goes.

A text is cut into lines and a line into clauses, at the marks that end them, so that the
units of a shared passage come out alike wherever in a line it stands. Units are
normalised (A-Z lowered, white space as one blank, closing marks dropped) and hashed. A
grouped aggregation finds the first document of each digest that occurs twice or more, and
a join on the digest marks the later occurrences; the commonest digests are broadcast, so
that a clause of every document isn't one task's work. Common short clauses repeat by chance, so
what is removed is a run of marked units of at least RUN_WORDS words, or marked whole lines
of at least LINE_WORDS words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vec
from plumbline.llm.names import fresh, join_counted, text_mark
from plumbline.shared import durable

#: Words of a run, and of whole lines, from which on it is removed.
RUN_WORDS, LINE_WORDS = 15, 5
_MARKS = ".!?,;:。！？，；：、｡､"
_CUT = re.compile(rf"[^\n{_MARKS}]*[\n{_MARKS}]+|[^\n{_MARKS}]+")
#: Letters of scripts that put no blanks between words (Thai, Lao, Burmese, Khmer, kana, Han), and how many count as a word.
_UNSPACED, UNSPACED_WORD = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"), 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Units, and texts, in a batch of rows that a worker returns, about.
OUT_UNITS, OUT_TEXTS = 1 << 15, 1 << 10
_SPANS = "array<struct<start:int,end:int,n_words:int,first_doc_id:long>>"


def units(text: str) -> list[str]:
    """Consecutive pieces that make up the whole text."""
    return _CUT.findall(text)


def normal_words(unit: str) -> tuple[bytes, int]:
    """The normal form of a unit and its number of words; a unit without words has an empty form."""
    words = unit.encode("utf-8", "replace").translate(_LOWER).split()
    form, n = b" ".join(words).rstrip(b".!?,;:"), len(words)
    if not unit.isascii():
        form = form.decode().rstrip(_MARKS).encode()
        rest, unspaced = _UNSPACED.subn(" ", unit.rstrip(_MARKS + " \t\n\v\f\r"))
        if unspaced:
            n = len(rest.encode("utf-8", "replace").split()) + -(-unspaced // UNSPACED_WORD)
    return form, n


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k, doc_id, mark, local, meta, place) of each unit with a word: 96 bits of its digest, a digest of its text, whether the
    text has it before, and, in two longs, its number among these, words and whether a line begins and ends with it but for units
    without words, and its start and end."""
    names = ["h", "k", "doc_id", "mark", "local", "meta", "place"]
    for batch in batches:
        digests, docs, marks, local, meta, place = [], [], [], [], [], []

        def rows():
            raw = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
            columns = [
                pa.array(raw[:, 0].view(np.int64)), pa.array((raw[:, 1] & 0x7FFFFFFF).astype(np.int32)), pa.array(docs, pa.int64()), pa.array(marks, pa.int64()),
                pa.array(local, pa.bool_()), pa.array(meta, pa.int64()), pa.array(place, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for doc, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text"), strict=True):
            seen, at, begins, n = set(), 0, True, 0
            text = text.as_py() or ""
            for unit in units(text):
                end = at + len(unit)
                ends = unit.endswith("\n") or end == len(text) or "\n" in unit
                form, words = normal_words(unit)
                if form:
                    digest = xxhash.xxh3_128_digest(form)
                    digests.append(digest)
                    docs.append(doc)
                    marks.append(mark)
                    local.append(digest in seen)
                    meta.append(n << 34 | words << 2 | begins << 1 | ends)
                    place.append(at << 32 | end)
                    seen.add(digest)
                    n, begins = n + 1, ends
                elif ends:
                    begins = True
                    if n:
                        meta[-1] |= 1
                at = end
            if len(docs) >= OUT_UNITS:
                yield rows()
                digests, docs, marks, local, meta, place = [], [], [], [], [], []
        if docs:
            yield rows()


def _runs(least_run: int, least_line: int):
    """Spans to remove of each document, from its marked units."""

    def spans(found: list[tuple]) -> list[dict]:
        out, run = [], []

        def close() -> None:
            part = run
            if sum(u[1] for u in part) < least_run:  # else only its whole lines
                begin = next((i for i, u in enumerate(part) if u[2]), len(part))
                end = next((i for i in range(len(part), begin, -1) if part[i - 1][3]), begin)
                part = part[begin:end]
                if sum(u[1] for u in part) < least_line:
                    return
            if part:
                out.append({"start": part[0][4], "end": part[-1][5], "n_words": sum(u[1] for u in part), "first_doc_id": part[0][6]})

        for unit in found:
            if run and unit[0] != run[-1][0] + 1:  # units without words aren't numbered, so they don't cut
                close()
                run = []
            run.append(unit)
        close()
        return out

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("found").to_pylist():
                rows = sorted((u["meta"], u["place"], u["first_doc_id"]) for u in row)
                out.append(spans([(m >> 34, m >> 2 & 0xFFFFFFFF, m >> 1 & 1, m & 1, p >> 32, p & 0xFFFFFFFF, f) for m, p, f in rows]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("first_doc_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(out, kind)], ["doc_id", "mark", "spans"])

    return run_


def repeated_spans(docs: DataFrame, least_run: int = RUN_WORDS, least_line: int = LINE_WORDS) -> DataFrame:
    """(doc_id, mark, spans) of the documents that repeat earlier text; offsets count code points of the original text.

    The document of the lowest doc_id keeps a unit, at its first place there; ``mark`` is a
    digest of the row's text. Rows that share a doc_id are one document, and none of them
    loses what another has. Rows without a doc_id have no rank: they are neither kept nor
    removed against. Null and empty texts have no units. An empty table gives no rows.
    """
    schema = "h long, k int, doc_id long, mark long, local boolean, meta long, place long"
    texts = docs.select(F.col("doc_id").cast("long"), text_mark(docs).alias("mark"), "text").filter("doc_id is not null and text is not null")
    found = texts.mapInArrow(vec.lean(_unit_rows), schema)
    firsts = durable(found.groupBy("h", "k").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).filter("n > 1"))
    later = join_counted(found, firsts, "h", "k", F.xxhash64("doc_id", "place")).filter("local or doc_id > first_doc_id")
    runs = later.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("meta", "place", "first_doc_id")).alias("found"))
    return runs.mapInArrow(vec.lean(_runs(least_run, least_line)), f"doc_id long, mark long, spans {_SPANS}").filter(F.size("spans") > 0)


def removed_spans(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id): a row for each removed span."""
    return repeated_spans(docs, **limits).select("doc_id", F.inline("spans"))


def _without(spans_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, OUT_TEXTS) for whole in batches for lo in range(0, whole.num_rows, OUT_TEXTS)):
            texts = []
            for text, spans in zip(batch.column("text"), batch.column(spans_name), strict=True):
                text, spans = text.as_py(), spans.as_py()
                if text is not None and spans:
                    kept, at = [], 0
                    for span in spans:
                        kept.append(text[at : span["start"]])
                        at = span["end"]
                    text = "".join([*kept, text[at:]])
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([spans_name])

    return run


def remove_repeats(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with its columns, ``text`` without its repeated spans, and n_chars, if there is one, counted anew.

    All rows stay; a text that is all repeated becomes empty.
    """
    doc, mark, spans = fresh(docs, "span_doc", "span_mark", "spans")
    found = repeated_spans(docs, **limits).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(spans))
    same = (docs["doc_id"] == found[doc]) & (text_mark(docs) == found[mark])
    rows = docs.join(found, same, "left").drop(doc, mark)
    out = rows.mapInArrow(vec.lean(_without(spans)), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
