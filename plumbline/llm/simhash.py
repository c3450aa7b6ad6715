"""SimHash near-dedup: fingerprints of 3-word shingles, linked by bit-sliced comparison.

Two fingerprints at most three bits apart agree on at least three of six bit blocks, so
each distinct fingerprint goes to the 20 buckets that three of its blocks name. A bucket
is compared bit-sliced: its members' bits stand in vertical planes, one machine word for
64 members, and a carry-save pair of words counts the differing bits of 64 pairs at a
time, with a third word for lanes beyond the radius. A block of members that is wholly
beyond it is left at once. A bucket gives at most one link for each member (to the first
member of its group), so groups of copies never become pairs. The members of a bucket above
TILE go on to four smaller buckets each: the bits that they needn't share are cut into four
parts, and members at most three bits apart share one of them. So no bucket is held whole
however large it is, and rows grow with the members, not with their pairs. Buckets that a
sample shows to be that large are cut before they are dealt to tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import graph, vec
from plumbline.llm.names import drop_rows, join_counted, text_mark
from plumbline.shared import durable

#: Differing bits up to which fingerprints link, words of a shingle, and the seed of their hash.
RADIUS, SHINGLE, SEED = 3, 3, 42
#: Members of a bucket that are compared with one another, at most.
TILE = 1 << 15
#: Fingerprints of the sample that shows large buckets, about, and of those, members of a bucket that count as proof.
SAMPLE, PROOF = 1 << 18, 32
_BLOCKS = (11, 11, 11, 11, 10, 10)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONE = np.uint64(1)


def masks() -> list[int]:
    """The bits of each choice of three of the six blocks, as signed longs."""
    blocks, at = [], 0
    for width in _BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(blocks, len(_BLOCKS) - RADIUS))]


@functools.lru_cache(1 << 12)
def narrower(mask: int) -> list[int]:
    """A mask of agreed bits with each part of the other bits added, one part more than differing bits allowed; none if the others are too few to matter."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = RADIUS + 1
    if len(free) < parts:
        return []
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    found = [(mask & (1 << 64) - 1) | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def shingle_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if len(words) > SHINGLE:
        words = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    elif words:
        words = [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, SEED) for w in words], np.uint64)


def fingerprint(text: str | None) -> int:
    """A bit is 1 where more than half of the shingles' hashes have 1; no words give 0."""
    hashes = shingle_hashes(text or "")
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp) of each row, with its text's mark and fp as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), text_mark(docs).alias("mark"), "text").mapInArrow(vec.lean(_fingerprints), "doc_id long, mark long, fp long")


def _planes(fps: np.ndarray, lane: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """Bit planes (64, words): the fingerprint at (word, lane) has its bits in that lane of each plane."""
    planes = np.zeros((64, words), np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    for p in range(64):
        planes[p, word[first]] = np.bitwise_or.reduceat(((fps >> np.uint64(p)) & _ONE) << lane, first)
    return planes


def _near(planes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Lanes of ``planes`` (64, W) within the radius of each query; asked (64, Q, W or 1) is all ones where a query's bit is set.

    Counts differing bits in two carry-save words and an overflow word; words beyond the radius in all lanes for all queries are left.
    """
    q, w = asked.shape[1], planes.shape[1]
    out = np.zeros((q, w), np.uint64)
    live = np.arange(w)
    ones = twos = over = np.zeros((q, w), np.uint64)
    own = asked.shape[2] > 1
    for p in range(64):
        differ = planes[p, live][None, :] ^ (asked[p][:, live] if own else asked[p])
        carry = ones & differ
        ones = ones ^ differ
        over = over | (twos & carry)
        twos = twos ^ carry
        if p % 8 == 7 and p < 63:
            keep = (over != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=0)
            if not keep.any():
                return out
            if not keep.all():
                live, ones, twos, over = live[keep], ones[:, keep], twos[:, keep], over[:, keep]
    out[:, live] = ~over
    return out


def _small_links(fps: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of many groups of 2 to 64 members at once: (member, first member of its cluster)."""
    b, most = len(size), int(size.max())
    word = np.repeat(np.arange(b), size)
    lane = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    own = fps[np.repeat(first, size) + lane]
    planes = _planes(own, lane.astype(np.uint64), word, b)
    lanes = np.arange(most, dtype=np.uint64)
    asked = np.uint64(0) - ((planes[:, None, :] >> lanes[None, :, None]) & _ONE)
    valid = np.where(size == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (_ONE << (size % 64).astype(np.uint64)) - _ONE)
    reach = _near(planes, asked) & valid[None, :]
    reach[lanes[:, None] >= size[None, :].astype(np.uint64)] = 0
    some = np.flatnonzero((reach & (reach - _ONE)).any(axis=0))  # a lane besides its own
    reach = reach[:, some]
    for k in range(most):
        reach |= (np.uint64(0) - ((reach >> np.uint64(k)) & _ONE)) & reach[k][None, :]
    lowest = reach & (np.uint64(0) - reach)
    member, group = np.nonzero((lowest != 0) & (lowest != _ONE << lanes[:, None]))
    at = first[some[group]]
    root = np.log2(lowest[member, group].astype(np.float64)).astype(np.int64)
    return fps[at + member], fps[at + root]


def _large_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group of any size: each member with the first of its cluster."""
    n = len(fps)
    w = -(-n // 64)
    at = np.arange(n)
    planes = _planes(fps, (at % 64).astype(np.uint64), at // 64, w)
    label = at.copy()
    for lo in range(0, n, 64):
        hi, words = min(n, lo + 64), lo // 64 + 1
        asked = np.uint64(0) - ((fps[None, lo:hi] >> np.arange(64, dtype=np.uint64)[:, None]) & _ONE)
        near = _near(planes[:, :words], asked[:, :, None])
        bits = np.unpackbits(near.view(np.uint8).reshape(hi - lo, -1), axis=1, bitorder="little")[:, : min(n, 64 * words)].view(bool)
        q, j = np.nonzero(bits & (label[None, : bits.shape[1]] != label[lo:hi, None]))
        q += lo
        while len(q):
            a, c = label[q], label[j]
            least = np.minimum(a, c)
            np.minimum.at(label, a, least)
            np.minimum.at(label, c, least)
            while (label[label] != label).any():
                label = label[label]
            apart = label[q] != label[j]
            q, j = q[apart], j[apart]
    moved = np.flatnonzero(label != at)
    return fps[moved], fps[label[moved]]


_LINKS = "m long, x long, y long"


def _rows(x: np.ndarray, y: np.ndarray | None = None, m: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [None if m is None else m, x.view(np.int64), None if y is None else y.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["m", "x", "y"])


def _linker(tile: int):
    """Links (x, y) within the groups of rows (g, m, x) sorted by g; members of a group above ``tile`` come out again as (m, x), for each narrower mask."""
    def closed(g: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        for lo, hi in ((2, 4), (5, 16), (17, 64)):
            (some,) = np.nonzero((size >= lo) & (size <= hi))
            for k in range(0, len(some), 4096):
                x, y = _small_links(fps, first[some[k : k + 4096]], size[some[k : k + 4096]])
                if len(x):
                    yield _rows(x, y)
        for k in np.flatnonzero(size > 64).tolist():
            x, y = _large_links(fps[first[k] : first[k] + size[k]])
            if len(x):
                yield _rows(x, y)

    def narrowed(m: np.ndarray, fps: np.ndarray, head: np.uint64) -> Iterator[pa.RecordBatch]:
        """Rows of the narrower buckets; where too few bits are free, all members are within the radius, and linked to the first."""
        for mask in np.unique(m).tolist():
            own = fps[m == mask]
            below = narrower(mask)
            if not below:
                yield _rows(own, np.full(len(own), head))
            for b in below:
                yield _rows(own, m=np.full(len(own), b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        g, m, x = none
        over, head = None, np.uint64(0)  # the group that has gone above the tile, and its first member
        for batch in batches:
            if not batch.num_rows:
                continue
            more = batch.column("g").to_numpy(), batch.column("m").to_numpy(), batch.column("x").to_numpy().view(np.uint64)
            if over is not None:
                cut = int(np.searchsorted(more[0], over, "right"))
                yield from narrowed(more[1][:cut], more[2][:cut], head)
                if cut == batch.num_rows:
                    continue
                over, more = None, tuple(c[cut:] for c in more)
            g, m, x = (np.concatenate(c) for c in zip((g, m, x), more, strict=True))
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[first, len(g)])
            for k in np.flatnonzero(size > tile).tolist():
                a, b = int(first[k]), int(first[k] + size[k])
                yield from narrowed(m[a:b], x[a:b], x[a])
                if b == len(g):
                    over, head = g[a], x[a]
            last = len(g) if over is not None else int(first[-1])  # the last group may go on in the next batch
            small = np.repeat(size <= tile, size)[:last]
            if small.any():
                yield from closed(g[:last][small], x[:last][small])
            g, m, x = none if over is not None else (g[last:], m[last:], x[last:])
        if len(g):
            yield from closed(g, x)

    return run


def _bucket(m: Column, x: Column) -> Column:
    return F.xxhash64(m, x.bitwiseAND(m))


def links(distinct: DataFrame, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """(u, v) links among distinct fingerprints (fp): those at most RADIUS bits apart are connected by them."""
    first = masks()
    each = F.explode(F.array(*[F.lit(m).cast("long") for m in first])).alias("m")
    rows = distinct.select(F.col("fp").alias("x"), each).select(_bucket(F.col("m"), F.col("x")).alias("g"), "m", "x")
    n = distinct.count()
    if n <= tile:  # no bucket can be larger
        found = rows.repartition("g").sortWithinPartitions("g").mapInArrow(vec.lean(_linker(tile)), _LINKS)
        return found.select(F.col("x").alias("u"), F.col("y").alias("v"))
    one_in = max(1, n // sample)
    seen = rows.filter(F.pmod(F.xxhash64(F.lit(7), "x"), F.lit(one_in)) == 0).groupBy("g").agg(F.count("*").alias("n"))
    large = durable(seen.filter((F.col("n") * one_in > tile) & (F.col("n") >= min(PROOF, tile))).select(F.col("g").alias("large")))  # at most 20 * sample / PROOF rows
    todo = rows
    if large.limit(1).count():
        below = F.create_map(*[c for m in first for c in (F.lit(m).cast("long"), F.array(*[F.lit(b).cast("long") for b in narrower(m)]))])
        known = rows.join(F.broadcast(large), F.col("g") == F.col("large"), "left")
        todo = known.select(F.explode(F.when(F.col("large").isNull(), F.array("m")).otherwise(F.element_at(below, F.col("m")))).alias("m"), "x")
        todo = todo.select(_bucket(F.col("m"), F.col("x")).alias("g"), "m", "x")
    out = None
    while True:
        found = durable(todo.repartition("g").sortWithinPartitions("g").mapInArrow(vec.lean(_linker(tile)), _LINKS))
        own = found.filter("y is not null").select(F.col("x").alias("u"), F.col("y").alias("v"))
        out = own if out is None else out.unionByName(own)
        more = found.filter("y is null")
        if not more.limit(1).count():
            return out
        todo = more.select(_bucket(F.col("m"), F.col("x")).alias("g"), "m", "x")


def _classes(prints: DataFrame, first: Column, tile: int) -> DataFrame:
    """(fp, zero, n, first): of each fingerprint the least ``first`` of its component, and how many rows have it."""
    distinct = durable(prints.groupBy("fp").agg(F.min(first).alias("least"), F.count("*").alias("n")))
    roots = graph.components(links(distinct.select("fp"), tile)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    sizes = placed.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    named = join_counted(placed.select("fp", F.col("n").alias("rows"), "root", F.lit(0).alias("zero")), durable(sizes.withColumn("zero", F.lit(0))), "root", "zero", F.xxhash64("fp"))
    return durable(named.select("fp", "zero", F.col("rows").alias("n"), "first"))


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text).

    Null and wordless texts have fingerprint zero and link like any other; rows that
    repeat a doc_id each give a row; a null doc_id gives a row with a null doc_id and
    never names a component, which is null if all its rows have none. Other columns
    aren't read. An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs))
    named = _classes(prints, F.col("doc_id"), tile)
    found = join_counted(prints.select("doc_id", "mark", "fp", F.lit(0).alias("zero")), named, "fp", "zero", F.xxhash64("doc_id", "mark"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` without near copies of earlier ones, all columns as they are: of each component the row of the lowest doc_id stays.

    A null doc_id comes after all others; of different texts of one doc_id that of the
    lowest hash comes first. Rows equal in doc_id and text are one document, which stays or
    goes as a whole.
    """
    prints = durable(fingerprints(docs))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    named = _classes(prints, rank, tile)
    found = join_counted(prints.select("doc_id", "mark", "fp", F.lit(0).alias("zero")), named, "fp", "zero", F.xxhash64("doc_id", "mark"))
    gone = found.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))))
    return drop_rows(docs, gone.select("doc_id", "mark"))
