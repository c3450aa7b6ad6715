"""Toxicity: a linear-chain conditional random field tags toxic tokens, and their marginals make a document's score.

A bounded sample of labelled rows teaches everything. Words and word beginnings that occur
in far more toxic than clean documents form a lexicon of log odds; a token of a toxic
document with high odds is a token labelled toxic. The field has two states and sees, of
each token and its neighbours, the bin of their odds. Its marginals come from forward and
backward passes; with two states each step is a linear-fractional map of the odds, and maps
compose, so a whole batch of texts runs in blocks, array by array. A document's score is a
logistic function of its expected number of toxic tokens and its largest marginal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vec
from plumbline.shared import durable

#: Labelled rows of each class that the models are fitted on, at most.
SAMPLE_ROWS = 1500
#: Tokens that the chain's weights are fitted on, about, in whole documents; no document of more is among them.
SAMPLE_TOKENS = 250_000
#: Entries of the lexicon, at most; toxic sample documents that an entry occurs in, at least.
LEXICON, SUPPORT = 50_000, 3
#: Standard deviations that an entry's log odds are lowered by: rare words are in toxic documents by chance.
DEVIATIONS = 2.3
#: Bytes of a word's beginnings that are features besides the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: Lower edges of the bins of log odds, and the odds from which a token of a toxic document counts as toxic.
EDGES = (0.25, 0.75, 1.25, 2.0, 3.0)
TOXIC_ODDS = 0.75
_FOLD = vec.fold_table(keep_punctuation=False)
_BLOCK = 64
_SCORED = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words, and hashes (words, 1 + prefixes) of each word and its beginnings."""
    folded = _FOLD[data]
    starts, ends, rows = vec.word_bounds(folded, offsets)
    hashes = vec.word_hashes(folded, starts, ends, PREFIXES)
    hashes[:, 1:] ^= np.array(PREFIXES, np.uint64)
    return starts, ends, rows, hashes


@dataclass
class Model:
    """What scoring needs; all of it is small, whatever the corpus."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    emit: np.ndarray = field(default_factory=lambda: np.zeros((3, len(EDGES) + 1)))  # previous, own and next token's bin
    chain: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, -4.0]))  # bias, 0->1, 1->0 and start
    head: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))  # bias, expected tokens, largest marginal

    def __post_init__(self) -> None:
        self._sieve = np.zeros(1 << 16, bool)
        self._sieve[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def bins(self, hashes: np.ndarray) -> np.ndarray:
        """The bin of each token's highest log odds."""
        best = np.zeros(len(hashes))
        if len(self.keys):
            for k in range(hashes.shape[1]):
                (hit,) = np.nonzero(self._sieve[(hashes[:, k] & np.uint64(0xFFFF)).astype(np.int64)])
                found = np.minimum(np.searchsorted(self.keys, hashes[hit, k]), len(self.keys) - 1)
                same = self.keys[found] == hashes[hit, k]
                np.maximum.at(best, hit[same], self.odds[found[same]])
        return np.digitize(best, EDGES).astype(np.uint8)


def compose(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r_t = (a_t r_{t-1} + b_t) / (c_t r_{t-1} + d_t) for all t, with r_{-1} = 1. All coefficients are at least 0.

    Maps of a block of tokens are composed for all blocks at once, the blocks are run
    through one after the other, and then all tokens of all blocks again from there.
    """
    n = len(a)
    blocks = -(-n // _BLOCK)
    m = np.zeros((4, blocks * _BLOCK))
    m[0], m[3] = 1.0, 1.0
    m[0, :n], m[1, :n], m[2, :n], m[3, :n] = a, b, c, d
    m = m.reshape(4, blocks, _BLOCK).transpose(0, 2, 1).copy()
    pa_, pb, pc_, pd = m[0, 0], m[1, 0], m[2, 0], m[3, 0]
    for t in range(1, _BLOCK):
        qa, qb, qc, qd = m[0, t], m[1, t], m[2, t], m[3, t]
        pa_, pb, pc_, pd = qa * pa_ + qb * pc_, qa * pb + qb * pd, qc * pa_ + qd * pc_, qc * pb + qd * pd
        scale = 1.0 / (pa_ + pb + pc_ + pd)
        pa_, pb, pc_, pd = pa_ * scale, pb * scale, pc_ * scale, pd * scale
    at, r = np.empty(blocks), 1.0
    for k, (w, x, y, z) in enumerate(zip(pa_.tolist(), pb.tolist(), pc_.tolist(), pd.tolist(), strict=True)):
        at[k] = r
        r = (w * r + x) / (y * r + z)
    out = np.empty((_BLOCK, blocks))
    for t in range(_BLOCK):
        at = (m[0, t] * at + m[1, t]) / (m[2, t] * at + m[3, t])
        out[t] = at
    return out.T.reshape(-1)[:n]


def neighbours(bins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of the previous and the next token of the same row; 0 at its ends."""
    before, after = np.zeros_like(bins), np.zeros_like(bins)
    if len(bins) > 1:
        same = rows[1:] == rows[:-1]
        before[1:], after[:-1] = np.where(same, bins[:-1], 0), np.where(same, bins[1:], 0)
    return before, after


def passes(model: Model, bins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission factors, forward odds and backward odds of the toxic state for each token."""
    before, after = neighbours(bins, rows)
    bias, w01, w10, begin = model.chain
    e = np.exp(np.clip(model.emit[0][before] + model.emit[1][bins] + model.emit[2][after] + bias, -20, 20))
    t01, t10 = np.exp(np.clip([w01, w10], -10, 10))
    first = np.r_[True, rows[1:] != rows[:-1]]
    last = np.r_[first[1:], True]
    zero, one = np.zeros(len(e)), np.ones(len(e))
    forward = compose(np.where(first, 0, e), np.where(first, e * np.exp(np.clip(begin, -20, 20)), e * t01), np.where(first, zero, t10), one)
    e_next = np.r_[e[1:], 1.0]
    a, b, c, d = e_next, one * t10, e_next * t01, one
    # odds of what follows: (t10 + e q) / (1 + t01 e q); after a row's last token there is nothing
    back = compose(*(np.where(last, x, y)[::-1] for x, y in ((zero, a), (one, b), (zero, c), (one, d))))[::-1]
    return e, forward, back


def marginals(model: Model, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if not len(bins):
        return np.zeros(0)
    _, forward, back = passes(model, bins, rows)
    odds = forward * back
    return odds / (1 + odds)


def fit_chain(model: Model, bins: np.ndarray, rows: np.ndarray, toxic: np.ndarray, steps: int = 60, rate: float = 0.25, decay: float = 1e-5) -> Model:
    """The chain's weights of highest penalised likelihood for labelled tokens, by Adam."""
    kinds, n = len(EDGES) + 1, len(bins)
    before, after = neighbours(bins, rows)
    y = toxic.astype(float)
    first = np.r_[True, rows[1:] != rows[:-1]]
    linked = ~first[1:]
    size = 3 * kinds + 4
    seen = np.concatenate([np.bincount(x, y, kinds) for x in (before, bins, after)] + [[y.sum(), ((1 - y[:-1]) * y[1:])[linked].sum(), (y[:-1] * (1 - y[1:]))[linked].sum(), y[first].sum()]])
    weights = np.concatenate([model.emit.ravel(), model.chain])
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        model = Model(model.keys, model.odds, weights[:-4].reshape(3, kinds), weights[-4:], model.head)
        e, forward, back = passes(model, bins, rows)
        p = forward * back / (1 + forward * back)
        t01, t10 = np.exp(np.clip(model.chain[1:3], -10, 10))
        on, off = forward[:-1], e[1:] * back[1:]
        both = 1 + on * t10 + t01 * off + on * off
        expected = np.concatenate(
            [np.bincount(x, p, kinds) for x in (before, bins, after)] + [[p.sum(), (t01 * off / both)[linked].sum(), (on * t10 / both)[linked].sum(), p[first].sum()]]
        )
        grad = (seen - expected) / n - decay * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weights = weights + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(model.keys, model.odds, weights[:-4].reshape(3, kinds), weights[-4:], model.head)


def document_features(p: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` rows: 1, log(1 + expected toxic tokens) and the largest marginal."""
    most = np.zeros(n)
    np.maximum.at(most, rows, p)
    return np.stack([np.ones(n), np.log1p(np.bincount(rows, p, n)), most], axis=1)


def fit_head(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
    return w


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): in how many documents of a slab of texts each feature occurs."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False))
        for row, data, offsets in vec.slabs(batch.column("text")):
            _, _, rows, hashes = token_features(data, offsets)
            pairs = np.unique(np.stack([np.repeat(rows, hashes.shape[1]).astype(np.uint64), hashes.ravel()], axis=1), axis=0) if len(rows) else np.zeros((0, 2), np.uint64)
            flags = toxic[row + pairs[:, 0].astype(np.int64)] > 0
            keys, which = np.unique(pairs[:, 1], return_inverse=True)
            hits, others = np.bincount(which, flags, len(keys)), np.bincount(which, ~flags, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(hits.astype(np.int64)), pa.array(others.astype(np.int64))], ["feature", "toxic", "clean"])


def _binned(model: Model):
    """(toxic, bins, n, mark) of each text: its tokens' bins, their number and a digest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in vec.slabs(batch.column("text")):
                _, _, rows, hashes = token_features(data, offsets)
                cuts = np.searchsorted(rows, np.arange(1, len(offsets) - 1))
                parts = [b.tobytes() for b in np.split(model.bins(hashes), cuts)]
                marks, sizes = [zlib.crc32(p) for p in parts], [len(p) for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(row, len(parts)), pa.array(parts, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64())], ["toxic", "bins", "n", "mark"])

    return run


def _summarised(model: Model):
    """(toxic, features) of each text from its tokens' bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column("bins").to_pylist():
                bins = np.frombuffer(raw, np.uint8)
                rows = np.zeros(len(bins), np.int64)
                found.append(document_features(marginals(model, bins, rows), rows, 1)[0].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "features"])

    return run


def fold(doc_id) -> F.Column:
    """0 to 4; the rows of fold 0 are held out of all learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)).cast("int")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows outside fold 0: at most SAMPLE_ROWS of each class, those of the lowest hashed doc_id.

    Class sizes, which set the score's base rate, are counted over all such rows. A
    doc_id with several labels counts as toxic if any says so; null labels and ids don't
    count. Without rows of both classes the model calls nothing toxic.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(fold("doc_id") != 0).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("rank"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(fold("doc_id") != 0).distinct()
    known = durable(known.join(ids, "doc_id", "left_semi"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    parts = [known.filter(F.col("toxic") == t).orderBy("rank", "doc_id").limit(SAMPLE_ROWS) for t in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).select("doc_id", "toxic", "rank"))  # at most 2 * SAMPLE_ROWS rows
    sample = durable(docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").repartition(8, "rank"))
    texts = sample.select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(_feature_counts, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = [min(sizes[t], SAMPLE_ROWS) for t in (0, 1)]
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    sure = odds - DEVIATIONS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    rated = counted.filter(F.col("toxic") >= SUPPORT).select("feature", sure.alias("odds")).filter(F.col("odds") >= EDGES[0])
    entries = rated.orderBy(F.desc("odds"), "feature").limit(LEXICON).toArrow()
    keys = entries["feature"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], entries["odds"].to_numpy()[order])

    binned = durable(texts.mapInArrow(_binned(model), "toxic int, bins binary, n long, mark long"))
    # whole texts in order of a digest, up to SAMPLE_TOKENS; a longer text isn't in the chain's sample
    sizes_ = binned.filter(F.col("n") <= SAMPLE_TOKENS).select("mark", "n").orderBy("mark", "n").collect()  # at most 2 * SAMPLE_ROWS rows
    total = np.cumsum([r["n"] for r in sizes_])
    last = sizes_[max(0, int(np.searchsorted(total, SAMPLE_TOKENS)) - 1)]["mark"] if sizes_ else -1
    some = binned.filter((F.col("n") <= SAMPLE_TOKENS) & (F.col("mark") <= last)).select("bins", "toxic").orderBy("mark", "bins", "toxic").collect()
    bins = np.frombuffer(b"".join(r["bins"] for r in some), np.uint8)
    rows = np.repeat(np.arange(len(some)), [len(r["bins"]) for r in some])
    if len(bins):
        toxic = (np.array([r["toxic"] for r in some])[rows] > 0) & (bins >= np.digitize(TOXIC_ODDS, EDGES))
        model = fit_chain(model, bins, rows, toxic)
    parts = sorted((tuple(r["features"]), r["toxic"]) for r in binned.mapInArrow(_summarised(model), "toxic int, features array<double>").collect())
    x = np.array([f for f, _ in parts])
    y = np.array([t for _, t in parts], float)
    weight = np.where(y > 0, sizes[1] / n[1], sizes[0] / n[0])
    model.head = fit_head(x, y, weight * len(y) / weight.sum())
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in vec.slabs(batch.column("text")):
                n = len(offsets) - 1
                starts, ends, rows, hashes = token_features(data, offsets)
                p = marginals(model, model.bins(hashes), rows)
                x = document_features(p, rows, n)
                score = 1 / (1 + np.exp(-np.clip(x @ model.head, -30, 30)))
                hit = np.flatnonzero(p >= 0.5)
                spans: list[list[dict]] = [[] for _ in range(n)]
                if len(hit):
                    points = np.cumsum((data & 0xC0) != 0x80)  # code points up to each byte
                    base = np.where(offsets[:-1] > 0, points[np.maximum(offsets[:-1], 1) - 1], 0)
                    for k in hit.tolist():
                        r = int(rows[k])
                        spans[r].append({"start": int(points[starts[k]] - 1 - base[r]), "end": int(points[ends[k] - 1] - base[r])})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), batch.column("held_out").slice(row, n), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)],
                    ["doc_id", "held_out", "score", "predicted", "spans"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of each row: spans are the toxic tokens, in code points.

    A null or wordless text has the score of no toxic token and no spans. A null doc_id
    isn't held out. Other columns aren't read. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "text")
    return texts.mapInArrow(_score(model), _SCORED)
