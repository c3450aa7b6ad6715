"""Language ID by Bayesian fusion of text, markup, address and host evidence.

log P(language | all) = log P(text | language) + log P(declared | language) + log P(language | host) + constant

The text's likelihood comes from byte trigrams, tempered, since neighbouring trigrams
aren't independent; beside the languages stands a background under which all trigrams are
equally likely, for texts that no language explains better. What a declaration is worth,
and each host's prior, come from grouped aggregations of the texts' own posteriors over all
rows. A host's counts are smoothed with its domain's, those with its suffix's, those with
the whole corpus's; a row's own share is taken out of all counts that judge it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vec
from plumbline.llm.names import drop_rows, join_counted, text_mark
from plumbline.shared import durable

#: Labelled rows of each language that the trigram model is fitted on, at most: those of the lowest hash.
SAMPLE_ROWS = 1000
#: Share of all declarations that a language of the model has, at least. Their number has no other bound.
LEAST_SHARE = 1e-5
#: Trigrams beyond which a text is no more certain, and the weight of each.
MOST_GRAMS, GRAM_WEIGHT = 400, 0.25
#: Prior of the background: that a text is in none of the languages.
BACKGROUND = 0.001
#: Rows that the next wider level of addresses counts for, and what an unseen declaration counts.
PRIOR_ROWS, DECLARED_ROWS = 8.0, 0.5
#: The posterior from which a row is kept.
LEAST_POSTERIOR = 0.5
#: Bytes of hosts' counts up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
_CODES = 1 << 16
_LEVELS = ("suffix", "domain", "host")


def _fold() -> np.ndarray:
    """Lower-case bytes; every ASCII character but letters counts as the blank."""
    table = vec.fold_table(keep_punctuation=False)
    table[table == 0] = 0x20
    table[ord("0") : ord("9") + 1] = 0x20
    return table


_FOLD = _fold()


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of the trigram that begins at each byte but the last two, and whether a letter is in its middle."""
    b = _FOLD[data].astype(np.uint32)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(_CODES - 1), b[1:-1] != 0x20


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Codes and validity for runs of bytes, with each row's own range in the run. A trigram doesn't span two rows."""
    for p in range(0, max(0, len(data) - 2), vec.SLAB):
        q = min(len(data) - 2, p + vec.SLAB)
        codes, valid = _grams(data[p : q + 2])
        lo = np.clip(offsets[:-1], p, q) - p
        yield codes, valid, lo, np.maximum(np.clip(offsets[1:] - 2, p, q) - p, lo)


def gram_sums(tables: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sum of each table's (languages, codes) entries over its trigrams, and their number."""
    sums, n = np.zeros((len(offsets) - 1, len(tables))), np.zeros(len(offsets) - 1, np.int64)
    for codes, valid, lo, hi in _pieces(data, offsets):
        codes = np.where(valid, codes, np.uint32(_CODES))  # the last entry of each table is 0
        for k, table in enumerate(tables):
            run = np.concatenate([[0.0], np.cumsum(table[codes], dtype=np.float64)])
            sums[:, k] += run[hi] - run[lo]
        run = np.concatenate([[0], np.cumsum(valid)])
        n += run[hi] - run[lo]
    return sums, n


@dataclass
class Model:
    languages: list[str]
    tables: np.ndarray  # (languages, codes + 1) of log probabilities; the last code stands for no trigram


def declared_language(value: Column) -> Column:
    """The primary subtag of a declared language (en of en-US), or null."""
    found = F.regexp_extract(F.lower(F.trim(value)), "^([a-z]{2,3})([-_].*)?$", 1)
    return F.nullif(found, F.lit(""))


def _table(group: pa.Table) -> pa.Table:
    """Log probabilities of a language's trigrams, each seen half a time more often than it was."""
    counts = np.zeros(_CODES)
    np.add.at(counts, group.column("code").to_numpy(), group.column("n").to_numpy())
    logs = np.log((counts + 0.5) / (counts.sum() + 0.5 * _CODES)).astype(np.float32)
    return pa.table({"declared": group.column("declared").slice(0, 1), "logs": pa.array([logs.tobytes()], pa.binary())})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(declared, code, n): how often each trigram occurs in a batch of labelled texts."""
    for batch in batches:
        declared = batch.column("declared").to_pylist()
        names = sorted(set(declared))
        index = {name: k for k, name in enumerate(names)}
        which = np.array([index[v] for v in declared], np.int64)
        for row, data, offsets in vec.slabs(batch.column("text")):
            own = which[row : row + len(offsets) - 1]
            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for codes, valid, lo, hi in _pieces(data, offsets):
                label = np.full(len(codes), -1, np.int64)
                label[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))] = np.repeat(own, hi - lo)
                use = valid & (label >= 0)
                some, times = np.unique(label[use] * _CODES + codes[use], return_counts=True)
                keys, n = np.concatenate([keys, some]), np.concatenate([n, times])
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in (keys // _CODES).tolist()], pa.string()), pa.array((keys % _CODES).astype(np.int32)), pa.array(n)], ["declared", "code", "n"])


def fit(rows: DataFrame) -> Model:
    """The trigram model of rows (doc_id, text, declared); rows without a doc_id, text or declaration don't count.

    Languages are counted over all rows; each one's table comes from a bounded sample of
    its own rows, so that rare languages have one too. Of texts of one doc_id the least is in it.
    """
    labelled = rows.filter("doc_id is not null and text is not null and declared is not null").select("declared", F.xxhash64("doc_id").alias("rank"), "text")
    seen = {r["declared"]: r["n"] for r in labelled.groupBy("declared").agg(F.count("*").alias("n")).collect()}  # two or three letters each
    spoken = {name: n for name, n in seen.items() if n >= LEAST_SHARE * sum(seen.values())}
    if not spoken:
        return Model([], np.zeros((0, _CODES + 1), np.float32))

    def upto(limits: dict[str, int]) -> Column:
        return F.col("rank") <= F.element_at(F.create_map(*[F.lit(v) for pair in sorted(limits.items()) for v in (pair[0], pair[1])]).cast("map<string,bigint>"), F.col("declared"))

    # hashes are even: of a common language only rows of a low hash can be among the lowest
    near = {name: min(2**63 - 1, int(-(2**63) + 2**64 * (2 * SAMPLE_ROWS + 100) / n)) for name, n in spoken.items()}
    ranks = labelled.select("declared", "rank").filter(F.coalesce(upto(near), F.lit(False))).distinct().groupBy("declared").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))  # some 2,100 of each
    last = {r["declared"]: r["last"] for r in ranks.select("declared", F.element_at(F.slice("ranks", 1, SAMPLE_ROWS), -1).alias("last")).collect()}
    sample = labelled.filter(F.coalesce(upto(last), F.lit(False))).groupBy("declared", "rank").agg(F.min("text").alias("text"))
    counted = sample.repartition(8, "rank").select("declared", "text").mapInArrow(vec.lean(_counts), "declared string, code int, n long").groupBy("declared", "code").agg(F.sum("n").alias("n"))
    tables = counted.groupBy("declared").applyInArrow(_table, "declared string, logs binary").collect()  # 256 KB for each language
    found = {r["declared"]: np.frombuffer(r["logs"], np.float32) for r in tables}
    out = np.zeros((len(found), _CODES + 1), np.float32)
    for k, name in enumerate(sorted(found)):
        out[k, :_CODES] = found[name]
    return Model(sorted(found), out)


def _softmax(logs: np.ndarray) -> np.ndarray:
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def _likelihoods(model: Model, keep: list[str]):
    """The texts' tempered log likelihoods (languages, then the background), posteriors of the languages, and numbers of trigrams, beside the columns ``keep``."""
    plain = -np.log(_CODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in vec.slabs(batch.column("text")):
                sums, n = gram_sums(model.tables, data, offsets)
                means = np.concatenate([sums / np.maximum(n, 1)[:, None], np.full((len(n), 1), plain)], axis=1)
                logs = means * (np.minimum(n, MOST_GRAMS) * GRAM_WEIGHT)[:, None]
                p = _softmax(logs + np.log([*[1 - BACKGROUND] * len(model.languages), BACKGROUND]))[:, :-1] * (n > 0)[:, None]
                kept = [batch.column(c).slice(row, len(n)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n), _lists(logs), _lists(p)], [*keep, "n_grams", "logs", "p"])

    return run


def documents_as_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows of evidence: ``lang`` is what was declared and ``source`` the host; there is no address."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long"), text_mark(docs).alias("mark"), F.coalesce("text", F.lit("")).alias("text"), declared_language(F.col("lang")).alias("declared"), F.col("source").alias("host"),
        none.alias("domain"), none.alias("suffix"),
    )


def pages_as_rows(pages: DataFrame) -> DataFrame:
    """Web pages as rows of evidence: the text without markup, the language of <html lang>, and host, domain and suffix of the URL."""
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z0-9_-]+)", 1)
    labels = F.split("host", r"\.")
    rows = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.xxhash64("html").alias("mark"), F.coalesce(text, F.lit("")).alias("text"), declared_language(declared).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return rows.select("*", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)).alias("domain"), F.element_at(labels, -1).alias("suffix"))


def _matrix(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of k numbers as a matrix, and which rows have one; a null is zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    has = np.asarray(column.is_valid())
    out = np.zeros((len(column), k))
    out[has] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out, has


def _fused(languages: list[str], corpus: np.ndarray, declared: dict[str, np.ndarray], least: float, keep: list[str]):
    """Posteriors of rows with their hosts', domains' and suffixes' counts."""
    k = len(languages)
    told = np.array([declared.get(name, np.zeros(k)) for name in languages])
    seen = told.sum(axis=0)
    index = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_grams").to_numpy()
            logs, p = _matrix(batch.column("logs"), k + 1)[0], _matrix(batch.column("p"), k)[0]
            prior = np.maximum(corpus - p, 0) + 1
            prior /= prior.sum(axis=1, keepdims=True)
            for level in _LEVELS:
                counts, has = _matrix(batch.column(f"{level}_n"), k)
                counts = np.where(has[:, None], np.maximum(counts - p, 0), 0)
                prior = (counts + PRIOR_ROWS * prior) / (counts.sum(axis=1, keepdims=True) + PRIOR_ROWS)
            fused = logs + np.log(np.concatenate([prior * (1 - BACKGROUND), np.full((len(n), 1), BACKGROUND)], axis=1))
            which = np.array([index.get(d, -1) for d in batch.column("declared").to_pylist()], np.int64)
            said = np.flatnonzero(which >= 0)
            if len(said):
                own, rest = np.maximum(told[which[said]] - p[said], 0) + DECLARED_ROWS, np.maximum(seen - p[said], 0) + DECLARED_ROWS * k
                fused[said, :k] += np.log(own / rest)
                fused[said, k] += np.log(own.sum(axis=1) / rest.sum(axis=1))
            post = _softmax(fused)
            best, by_text = post.argmax(axis=1), logs.argmax(axis=1)
            names = [*languages, None]
            has = n > 0
            columns = [
                pa.array([names[b] if h else None for b, h in zip(best.tolist(), has.tolist(), strict=True)], pa.string()), pa.array(post.max(axis=1), mask=~has),
                pa.array([names[b] if h else None for b, h in zip(by_text.tolist(), has.tolist(), strict=True)], pa.string()), pa.array(n), pa.array(has & (best < k) & (post.max(axis=1) >= least)),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], [*keep, "language", "posterior", "text_language", "n_grams", "kept"])

    return run


_JUDGED = "language string, posterior double, text_language string, n_grams long, kept boolean"


def identify(rows: DataFrame, model: Model, least: float = LEAST_POSTERIOR, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(language, posterior, text_language, n_grams, kept) of each row of evidence, after its columns ``keep``.

    A row without a letter has no language and isn't kept, nor is one that the background
    explains best, or whose best posterior is below ``least``. A null or unknown declaration
    says nothing; a null host has the prior of its domain, a null domain that of its
    suffix, a null suffix that of the corpus. Of equal posteriors the first language in
    order wins. Rows that repeat a doc_id are judged each by its own text. An empty table,
    or a model without languages, gives no languages.
    """
    k = len(model.languages)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    if not k:
        none = F.lit(None).cast("string")
        return rows.select(*keep, none.alias("language"), F.lit(None).cast("double").alias("posterior"), none.alias("text_language"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("kept"))
    passed = [*keep, "declared", *_LEVELS]
    schema = f"{kept}, declared string, suffix string, domain string, host string, n_grams long, logs array<double>, p array<double>"
    scored = durable(rows.select(*passed, "text").mapInArrow(vec.lean(_likelihoods(model, passed)), schema))
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]
    counts = F.array(*[F.col(f"s{i}") for i in range(k)])

    known = F.when(F.col("declared").isin(model.languages), F.col("declared")).alias("declared")
    said = scored.select(known, "p").groupBy("declared").agg(*sums).collect()  # a row for each language
    declared = {r["declared"]: np.array([r[f"s{i}"] for i in range(k)]) for r in said}
    total = sum(declared.values(), np.zeros(k))
    declared.pop(None, None)

    def wider(table: DataFrame, level: str, by: list[str]) -> DataFrame:
        return table.groupBy(*by).agg(*[F.sum(F.get(f"{level}_n", F.lit(i))).alias(f"s{i}") for i in range(k)])

    # nulls are a group of their own, whose counts say nothing: its rows keep the wider level's prior
    by_host = scored.groupBy(*_LEVELS).agg(*sums, F.count("*").alias("n")).select(*_LEVELS, "n", counts.alias("host_n"))
    by_domain = wider(by_host, "host", ["suffix", "domain"]).select("suffix", "domain", counts.alias("domain_n"))
    by_suffix = wider(by_domain, "domain", ["suffix"]).select(F.col("suffix").alias("_suffix"), counts.alias("suffix_n"))
    wide = by_domain.join(by_suffix, F.col("suffix").eqNullSafe(F.col("_suffix"))).select("_suffix", F.col("domain").alias("_domain"), "domain_n", "suffix_n")
    table = by_host.join(wide, F.col("suffix").eqNullSafe(F.col("_suffix")) & F.col("domain").eqNullSafe(F.col("_domain")))
    key = [F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in _LEVELS], *[F.col(c).isNull() for c in _LEVELS]), F.shiftrightunsigned(F.xxhash64(F.lit(3), *[F.coalesce(F.col(c), F.lit("")) for c in _LEVELS]), 2)]
    table = durable(table.select(key[0].alias("a"), key[1].alias("b"), "n", *[F.when(F.col(c).isNotNull(), F.col(f"{c}_n")).alias(f"{c}_n") for c in _LEVELS]))
    keyed = scored.select(*keep, "declared", "n_grams", "logs", "p", key[0].alias("a"), key[1].alias("b"))
    most = BROADCAST_BYTES // (24 * k + 64)
    if table.limit(most + 1).count() <= most:
        joined = keyed.join(F.broadcast(table.drop("n")), ["a", "b"])
    else:
        joined = join_counted(keyed, table, "a", "b", F.xxhash64("n_grams", F.get("logs", F.lit(0))))
    joined = joined.select(*keep, "declared", "n_grams", "logs", "p", *[f"{c}_n" for c in _LEVELS])
    return joined.mapInArrow(vec.lean(_fused(model.languages, total, declared, least, list(keep))), f"{kept}, {_JUDGED}")


def keep_identified(docs: DataFrame, least: float = LEAST_POSTERIOR) -> DataFrame:
    """The rows of ``docs`` (the documents table) whose language is identified, all columns as they are; each row is judged by its own text, with or without a doc_id."""
    rows = documents_as_rows(docs)
    found = identify(rows, fit(rows), least, ("doc_id", "mark"))
    return drop_rows(docs, found.filter(~F.col("kept")).select("doc_id", "mark"))
