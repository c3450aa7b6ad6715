"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of BLOCK words. Document frequencies are counted over the blocks
of all documents, hashed to TERMS terms. RANK directions tell only so many items apart, so
the benchmark is dealt to groups of about GROUP_PASSAGES passages. For each group a
distributed randomised SVD of the TF-IDF vectors of passages (all of the corpus, and the
group's) gives each term RANK latent coordinates: one pass multiplies the passages' Gram
matrix with a random basis, the same for all groups, a second measures it in the basis that
each group gets from that. The latent vector of a
passage is a sum over its terms, so a pass over the corpus sums blocks, adds them up to
windows of two to four blocks, and multiplies windows with the passages of that length, and
the longest with all. Pairs above a cosine are checked word by word: by the longest common subsequence
with the whole item and, for paraphrases, with its answer. All documents and all windows
are compared with all items; only what is verified leaves a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vec
from plumbline.llm.names import drop_rows, text_mark
from plumbline.shared import durable, release

#: Words of a block; blocks of a window, of which one begins at every block: the fewest that hold a passage wherever it begins, up to WINDOW.
BLOCK, SHORT_WINDOW, WINDOW = 16, 2, 4
#: Hashed terms, latent dimensions, extra dimensions of the random projection.
TERMS, RANK, EXTRA = 1 << 15, 64, 8
#: What all passages of the corpus weigh together in the fit, at most, each the same; one weighs no more than 1.
CORPUS_WEIGHT = 8192.0
#: What a benchmark passage weighs in the fit: the directions are to tell items from the corpus and from one another.
ITEM_WEIGHT = 20.0
#: Passages in a row of the table that the fit reads, and those that a task of its first pass multiplies, about: a task returns 9 MB.
PACK, TASK_PASSAGES = 32, 1 << 18
#: Cosine from which a window is checked against an item.
LEAST_COSINE = 0.75
#: Shares of an item's words in order that make a copy, and with its answer a paraphrase; and the share of the answer.
COPY, PARAPHRASE, ANSWER = 0.8, 0.5, 0.8
#: Passages of a group of items, about, which a fit of its own tells apart, and groups that one pass over the corpus compares with (8 MB each).
GROUP_PASSAGES, GROUPS_A_PASS = 256, 16
_FOLD = vec.fold_table(keep_punctuation=False)
_CHUNK = 2048
_PASSAGE = WINDOW * BLOCK
_FIT_CHUNK = 8192
_MARK = re.compile(r"(?i)\banswer\s*:")
_SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*")


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of a slab of texts, and the row of each."""
    folded = _FOLD[data]
    starts, ends, rows = vec.word_bounds(folded, offsets)
    return vec.word_hashes(folded, starts, ends), rows


def blocks_of(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms (blocks, BLOCK) padded with TERMS, the row of each block, and the number of the first word of each."""
    if not len(rows):
        return np.zeros((0, BLOCK), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size = np.diff(np.r_[first, len(rows)])
    count = -(-size // BLOCK)
    base = np.cumsum(count) - count
    place = np.arange(len(rows)) - np.repeat(first, size)
    out = np.full((int(count.sum()), BLOCK), TERMS, np.int32)
    out[np.repeat(base, size) + place // BLOCK, place % BLOCK] = (hashes & np.uint64(TERMS - 1)).astype(np.int32)
    inner = np.arange(len(out)) - np.repeat(base, count)
    return out, np.repeat(rows[first], count), np.repeat(first, count) + inner * BLOCK


def passages_of(terms: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The passages (n, 64) of texts' blocks, padded with TERMS: each text cut into the fewest of at most WINDOW blocks, as even as can be. Terms are in order."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size = np.diff(np.r_[first, len(rows)])
    count = -(-size // WINDOW)
    inner = np.arange(len(rows)) - np.repeat(first, size)
    which = np.repeat(np.cumsum(count) - count, size) + inner * np.repeat(count, size) // np.repeat(size, size)
    begins = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    out = np.full((len(begins), WINDOW, BLOCK), TERMS, np.uint16)
    out[which, np.arange(len(rows)) - begins[which]] = terms
    return np.sort(out.reshape(-1, _PASSAGE), axis=1)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts: all passages, PACK in a row (terms); the blocks that hold each term (key, n), and the numbers of blocks and of passages (TERMS, n), (TERMS + 1, n)."""
    seen = np.zeros(TERMS + 2, np.int64)
    for batch in batches:
        for _, data, offsets in vec.slabs(batch.column("text")):
            terms, rows, _ = blocks_of(*terms_of(data, offsets))
            if not len(terms):
                continue
            ordered = np.sort(terms, axis=1)
            fresh = np.ones(terms.shape, bool)
            fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
            blocks = np.bincount(ordered[fresh], minlength=TERMS + 1)  # the last is the padding
            seen[:TERMS] += blocks[:TERMS]
            found = passages_of(terms, rows)
            seen[TERMS:] += len(terms), len(found)
            packed = [found[lo : lo + PACK].tobytes() for lo in range(0, len(found), PACK)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(packed), pa.int64()), pa.nulls(len(packed), pa.int64()), pa.array(packed, pa.binary())], ["key", "n", "terms"])
    (some,) = np.nonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), pa.nulls(len(some), pa.binary())], ["key", "n", "terms"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passages (n, 64) of a batch of rows (terms, weight), padded with TERMS, terms in order, and the weight of each. A row has passages of 64 terms, of which the last may be shorter."""
    found, weights = [], []
    for raw, weight in zip(batch.column("terms"), batch.column("weight").to_pylist(), strict=True):
        own = np.frombuffer(raw.as_py(), np.uint16)
        found.append(np.r_[own, np.full(-len(own) % _PASSAGE, TERMS, np.uint16)].reshape(-1, _PASSAGE))
        weights.append(np.full(len(found[-1]), weight))
        if PACK * len(found) >= _FIT_CHUNK:
            yield np.sort(np.concatenate(found), axis=1), np.concatenate(weights)
            found, weights = [], []
    if found:
        yield np.sort(np.concatenate(found), axis=1), np.concatenate(weights)


def _scaled(idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What each term adds to a passage's coordinates; the padding, nothing."""
    return np.concatenate([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)


def _random_basis() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((TERMS, RANK + EXTRA), np.float32)


def _counts(idf: np.ndarray, passages: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The passages' weights by the squared lengths of their TF-IDF vectors, which are so brought to length one."""
    flat = passages.ravel()
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]] | (np.arange(len(flat)) % _PASSAGE == 0))
    times = np.diff(np.r_[starts, len(flat)])
    square = np.bincount(starts // _PASSAGE, (times * np.r_[idf, 0.0][flat[starts]]) ** 2, len(passages))
    return np.divide(weights, square, out=np.zeros(len(passages)), where=square > 0)


def _coordinates(table: np.ndarray, passages: np.ndarray) -> np.ndarray:
    out = np.zeros((len(passages), table.shape[1]), np.float32)
    for j in range(_PASSAGE):
        out += table[passages[:, j]]
    return out


def _add_product(out: np.ndarray, table: np.ndarray, idf: np.ndarray, passages: np.ndarray, weights: np.ndarray) -> None:
    """Adds to ``out`` (TERMS, columns) what the passages' Gram matrix times the basis of ``table`` is, but for the factor idf of each term."""
    ahead = _coordinates(table, passages) * _counts(idf, passages, weights).astype(np.float32)[:, None]
    flat = passages.ravel()
    order = np.argsort(flat, kind="stable")[: int((flat < TERMS).sum())]  # the padding comes last
    for lo in range(0, len(order), 1 << 14):
        own = order[lo : lo + (1 << 14)]
        terms = flat[own]
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        out[terms[starts]] += np.add.reduceat(ahead[own // _PASSAGE], starts, axis=0)


def _add_squares(out: np.ndarray, table: np.ndarray, idf: np.ndarray, passages: np.ndarray, weights: np.ndarray) -> None:
    """Adds to ``out`` (columns, columns) what the passages' Gram matrix is in the basis of ``table``."""
    own = _coordinates(table, passages).astype(np.float64)
    out += own.T @ (own * _counts(idf, passages, weights)[:, None])


def _gram_product(idf: np.ndarray):
    """A task's share of (transposed A) A times the random basis, in 64 slices of rows; A's rows are TF-IDF passages of length one."""

    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out = _scaled(idf, _random_basis()), np.zeros((TERMS, RANK + EXTRA), np.float32)
        for batch in batches:
            for passages, weights in _unpacked(batch):
                _add_product(out, table, idf, passages, weights)
        out *= idf[:, None]
        yield _parts(np.split(out, 64), TaskContext.get().partitionId())

    return run


def _gram_squares(idf: np.ndarray, shared):
    """A task's share of (transposed A) A in each of several bases, a slice each."""

    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        out = np.zeros((len(tables), RANK + EXTRA, RANK + EXTRA))
        for batch in batches:
            for passages, weights in _unpacked(batch):
                for own, table in zip(out, tables, strict=True):
                    _add_squares(own, table, idf, passages, weights)
        yield _parts(list(out), TaskContext.get().partitionId())

    return run


def _parts(slices: list[np.ndarray], task: int) -> pa.RecordBatch:
    n = len(slices)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([s.astype(np.float32).tobytes() for s in slices], pa.binary()), pa.array([task] * n, pa.int32())], ["slice", "part", "task"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each slice's parts, which come one after the other."""
    last, total = None, None
    for batch in batches:
        for k, part in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
            own = np.frombuffer(part.as_py(), np.float32)
            if k == last:
                total += own
                continue
            if total is not None:
                yield _parts_of(last, total)
            last, total = k, own.astype(np.float64)
    if total is not None:
        yield _parts_of(last, total)


def _parts_of(k: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["slice", "part"])


def _sum_over(passages: DataFrame, run, shape: tuple[int, ...]) -> np.ndarray:
    """What ``run`` makes of all passages, added up on the executors in the tasks' order; of ``shape`` for each slice."""
    parts = passages.mapInArrow(vec.lean(run), "slice int, part binary, task int").repartition("slice").sortWithinPartitions("slice", "task")
    found = parts.mapInArrow(_summed, "slice int, part binary").toArrow().sort_by("slice")["part"]
    return np.concatenate([np.frombuffer(p.as_py(), np.float32).reshape(shape) for p in found] or [np.zeros((0, *shape[1:]), np.float32)])


def gram_product(passages: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The Gram matrix (TERMS, TERMS) of all ``passages`` (terms, weight) times the random basis; its size is fixed."""
    out = _sum_over(passages, _gram_product(idf), (TERMS // 64, RANK + EXTRA))
    return out if len(out) else np.zeros((TERMS, RANK + EXTRA), np.float32)


def group_terms(passages: DataFrame, idf: np.ndarray, product: np.ndarray, groups: list[np.ndarray]) -> list[np.ndarray]:
    """For each group's own passages (n, 64) orthonormal latent directions (TERMS, RANK) of these and of ``passages``, whose ``gram_product`` is given. One pass over ``passages`` serves all groups."""
    first, bases = _scaled(idf, _random_basis()), []
    for own in groups:
        more = np.zeros_like(product)
        _add_product(more, first, idf, own, np.full(len(own), ITEM_WEIGHT))
        bases.append(np.linalg.qr(product + idf[:, None] * more)[0].astype(np.float32))
    shared = passages.sparkSession.sparkContext.broadcast([_scaled(idf, basis) for basis in bases])
    squares = _sum_over(passages, _gram_squares(idf, shared), (1, RANK + EXTRA, RANK + EXTRA)).astype(np.float64)
    shared.destroy()
    out = []
    for k, (own, basis) in enumerate(zip(groups, bases, strict=True)):
        gram = squares[k] if len(squares) else np.zeros((RANK + EXTRA, RANK + EXTRA))
        _add_squares(gram, _scaled(idf, basis), idf, own, np.full(len(own), ITEM_WEIGHT))
        values, vectors = np.linalg.eigh(gram)
        out.append((basis @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32))
    return out


def latent_terms(passages: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Orthonormal latent directions (TERMS, RANK) of ``passages`` (terms, weight) alone, by a randomised SVD in two passes."""
    return group_terms(passages, idf, gram_product(passages, idf), [np.zeros((0, _PASSAGE), np.uint16)])[0]


def answer_of(text: str) -> str:
    """What follows ``answer:``, or else the last sentence."""
    marked = _MARK.split(text)
    if len(marked) > 1 and marked[-1].strip():
        return marked[-1]
    sentences = _SENTENCE.findall(text)
    return sentences[-1] if sentences else text


def _hash_text(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return terms_of(data, np.array([0, len(data)]))[0]


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, a word of ``words`` at a time over a bit vector of ``item``."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        hit = row & places.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def window_blocks(words: int) -> int:
    """Blocks of the shortest window that holds a passage of ``words`` words wherever in a block it begins."""
    return min(WINDOW, max(SHORT_WINDOW, -(-(words + BLOCK - 1) // BLOCK)))


@dataclass
class Items:
    """Benchmark items of one group: their words and answers, and the vectors of their passages, with the blocks of the windows to compare them with."""

    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    vectors: np.ndarray
    owner: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]], table: np.ndarray) -> Items:
        ids, words, answers, vectors, owner, blocks = [], [], [], [], [], []
        for item, text in rows:
            hashes = _hash_text(text)
            if not len(hashes):
                continue
            answers.append(_hash_text(answer_of(text)).tolist())
            for lo in range(0, max(1, len(hashes) - 2 * BLOCK), 2 * BLOCK):
                own = hashes[lo : lo + WINDOW * BLOCK]
                v = table[(own & np.uint64(TERMS - 1)).astype(np.int64)].sum(axis=0)
                if (norm := np.linalg.norm(v)) > 0:
                    vectors.append(v / norm)
                    owner.append(len(ids))
                    blocks.append(window_blocks(len(own)))
            ids.append(item)
            words.append(hashes.tolist())
        return cls(ids, words, answers, np.array(vectors, np.float32).reshape(-1, table.shape[1]), np.array(owner, np.int64), np.array(blocks, np.int64))


def window_vectors(table: np.ndarray, terms: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first block, blocks of a window, unit vectors) for runs of windows; a window ends with its text. ``table`` has a zero row at the end."""
    for lo in range(0, len(terms), _CHUNK):
        hi = min(len(terms), lo + _CHUNK)
        upto = min(len(terms), hi + WINDOW - 1)
        blocks = table[terms[lo:upto]].sum(axis=1)
        own = rows[lo:upto]
        sums = blocks[: hi - lo].copy()
        for k in range(1, WINDOW):
            n = max(0, min(hi - lo, len(own) - k))
            sums[:n] += np.where((own[k : k + n] == own[:n])[:, None], blocks[k : k + n], 0)
            if k + 1 >= SHORT_WINDOW:
                norm = np.sqrt(np.einsum("ij,ij->i", sums, sums))
                yield lo, k + 1, sums / np.maximum(norm, 1e-20)[:, None]


def candidates(items: Items, table: np.ndarray, terms: np.ndarray, rows: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
    """(first block, item, cosine) of the windows that come near a passage of an item."""
    by_blocks = {}
    for k in {*items.blocks.tolist(), WINDOW}:  # the longest window is for all, as a copy may be stretched
        own = (items.blocks == k) | (k == WINDOW)
        by_blocks[k] = (items.vectors[own].T, items.owner[own])
    for lo, k, vectors in window_vectors(table, terms, rows):
        if k not in by_blocks:
            continue
        passages, owner = by_blocks[k]
        near = vectors @ passages
        for w in np.flatnonzero(near.max(axis=1) >= least).tolist():
            for p in np.flatnonzero(near[w] >= least).tolist():
                yield lo + w, int(owner[p]), float(near[w, p])


def _search(shared, least: float):
    """(doc_id, mark, item_id, cosine, lcs_ratio, answer_ratio, first_word) of verified pairs, the best of each window kept per text and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(items, table, [np.unique(np.array(w, np.uint64)) for w in items.words]) for items, table in shared.value]
        for batch in batches:
            docs, marks = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()
            out: dict[tuple, tuple] = {}  # of (row, item_id)
            for row, data, offsets in vec.slabs(batch.column("text")):
                hashes, own = terms_of(data, offsets)
                terms, rows, first = blocks_of(hashes, own)
                if not len(terms):
                    continue
                bounds = np.searchsorted(own, np.arange(len(offsets)))
                for items, table, sets in groups:
                    checked = set()
                    for block, item, cosine in candidates(items, table, terms, rows, least):
                        r = int(rows[block])
                        m = len(items.words[item])
                        lo, hi = max(int(bounds[r]), int(first[block]) - m), min(int(bounds[r + 1]), int(first[block]) + WINDOW * BLOCK + m)
                        if (r, item, lo, hi) in checked:
                            continue
                        checked.add((r, item, lo, hi))
                        region = hashes[lo:hi]
                        found = sets[item]
                        at = np.minimum(np.searchsorted(found, region), len(found) - 1)
                        if (found[at] == region).sum() < PARAPHRASE * m:
                            continue
                        words = region.tolist()
                        ratio = common_subsequence(items.words[item], words) / m
                        if ratio < PARAPHRASE:
                            continue
                        answer = common_subsequence(items.answers[item], words) / max(1, len(items.answers[item]))
                        if ratio >= COPY or answer >= ANSWER:
                            key = (row + r, items.ids[item])
                            best = (ratio, round(cosine, 4), answer, lo - int(bounds[r]))
                            if key not in out or best > out[key]:
                                out[key] = best
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[r] for r, _ in out], pa.int64()), pa.array([marks[r] for r, _ in out], pa.int64()), pa.array([i for _, i in out], pa.int64()), pa.array([v[1] for v in out.values()], pa.float64()),
                        pa.array([v[0] for v in out.values()], pa.float64()), pa.array([v[2] for v in out.values()], pa.float64()), pa.array([v[3] for v in out.values()], pa.int64()),
                    ],
                    ["doc_id", "mark", "item_id", "cosine", "lcs_ratio", "answer_ratio", "first_word"],
                )

    return run


_FOUND = "doc_id long, mark long, item_id long, cosine double, lcs_ratio double, answer_ratio double, first_word long"


def _pairs(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """Verified pairs of texts and items; of a text with itself and an item there may be several."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_mark(docs).alias("mark"), "text")
    items = durable(benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct())
    groups = max(1, -(-items.select("text").mapInArrow(_item_passages, "terms binary").count() // GROUP_PASSAGES))
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    survey = durable(texts.select("text").mapInArrow(vec.lean(_survey), "key long, n long, terms binary"))
    counted = survey.filter("n is not null").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # a row for each of TERMS
    seen = np.zeros(TERMS + 2)
    seen[counted["key"].to_numpy()] = counted["n"].to_numpy()
    idf = (np.log((seen[TERMS] + 2) / (seen[:TERMS] + 1)) ** 2).astype(np.float32)  # squared: rare words tell passages apart

    total = int(seen[TERMS + 1])
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_PASSAGES)
    passages = survey.filter("n is null").select("terms", F.lit(CORPUS_WEIGHT / max(CORPUS_WEIGHT, total)).alias("weight")).coalesce(tasks)
    found = product = None
    for first in range(0, groups, GROUPS_A_PASS):
        parts = [[(r["item_id"], r["text"]) for r in items.filter(group == k).orderBy(F.xxhash64("text")).collect()] for k in range(first, min(groups, first + GROUPS_A_PASS))]  # some GROUP_PASSAGES each
        parts = [part for part in parts if any(len(_hash_text(text)) for _, text in part)]
        if not parts:
            continue
        if product is None:
            product = gram_product(passages, idf)
        models = []
        for part, directions in zip(parts, group_terms(passages, idf, product, [np.concatenate([item_passages(text) for _, text in part]) for part in parts]), strict=True):
            table = _scaled(idf, directions)
            asked = Items.of(part, table)
            if len(asked.vectors):
                models.append((asked, table))
        if not models:
            continue
        hits = texts.mapInArrow(vec.lean(_search(spark.sparkContext.broadcast(models), least)), _FOUND)
        found = hits if found is None else found.unionByName(hits)
    release(survey)
    return found if found is not None else spark.createDataFrame([], _FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_ratio, answer_ratio, first_word): a row for each text of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it holds.

    ``first_word`` is where the checked stretch of the text begins. Null texts and texts
    without words hold nothing and are nothing to hold; rows that repeat an id each count,
    and equal pairs of ids give one row, the best: by the subsequence, then the cosine,
    then the answer. Other columns aren't read. Empty tables give no rows.
    """
    found = _pairs(docs, benchmark, least)
    best = F.max(F.struct("lcs_ratio", "cosine", "answer_ratio", "first_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs_ratio", "best.answer_ratio", "best.first_word")


def item_passages(text: str) -> np.ndarray:
    """The passages (n, 64) of a benchmark text that are searched for, padded with TERMS, terms in order."""
    terms = (_hash_text(text) & np.uint64(TERMS - 1)).astype(np.uint16)
    found = [terms[lo : lo + _PASSAGE] for lo in range(0, max(1, len(terms) - 2 * BLOCK), 2 * BLOCK)]
    return np.sort([np.r_[own, np.full(_PASSAGE - len(own), TERMS, np.uint16)] for own in found], axis=1)


def _item_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The benchmark's passages, a row each."""
    for batch in batches:
        out = [own.tobytes() for text in batch.column("text").to_pylist() for own in item_passages(text)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["terms"])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are; each row is judged by its own text, with or without a doc_id."""
    return drop_rows(docs, _pairs(docs, benchmark, least).select("doc_id", "mark"))
