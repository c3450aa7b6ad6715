"""Token ids as Parquet list columns: encoding, the file format, and selective reads.

Files hold one row a document in ascending doc_id order: ``doc_id``, ``part`` and
``part_start`` (where the document begins within its file), ``n_tokens`` and the list
``ids``. Row groups and pages are of a set size, pages are indexed, and ids are
dictionary or delta encoded, so that a reader takes the metadata columns alone, or the
pages of a range of documents.

The tokenizer's own library encodes each distinct stretch of text once: a worker cuts the
UTF-8 buffer of a batch where pre-tokens are certain to begin, hashes the stretches with
array operations, looks them up in a table that the worker keeps, compares the bytes, and
hands the library only those it hasn't seen. Texts in which the cuts may not hold (white
space beyond ASCII, strings of added tokens, a hash shared by two stretches) and texts for
a tokenizer of another kind are handed to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import vec
from plumbline.shared import new_path

#: The id that ends a document.
END_ID = 0
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Rows of the list of parts up to which it is broadcast: 16 bytes each.
BROADCAST_PARTS = 1 << 17
#: Units that a worker's table holds, at most, but for a slab that alone has more.
_FULL = 1 << 20
#: Units that the library encodes at once.
_ASKED = 4096

# white space beyond ASCII, as UTF-8: fixed values of Unicode's White_Space property
_WIDE_SPACES = [bytes.fromhex(h) for h in "c285 c2a0 e19a80 e28080 e28081 e28082 e28083 e28084 e28085 e28086 e28087 e28088 e28089 e2808a e280a8 e280a9 e280af e2819f e38080".split()]


def _classes() -> np.ndarray:
    """Of each byte: 0 letter, digit or part of a non-ASCII character; 1 white space; 2 other ASCII."""
    kinds = np.zeros(256, np.uint8)
    for b in range(128):
        kinds[b] = 1 if b == 0x20 or 0x09 <= b <= 0x0D else 0 if bytes([b]).isalnum() else 2
    return kinds


_CLASS = _classes()
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a pre-token begins for certain: the texts' starts, and

    - white space after something else,
    - what follows a lone white-space character other than the blank (a blank may belong to the next pre-token),
    - ASCII punctuation after an ASCII letter or digit.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    space = kind == 1
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    cut = first.copy()
    cut[1:] |= space[1:] & ~space[:-1]
    cut[1:] |= (kind[1:] == 2) & (kind[:-1] == 0) & (data[:-1] < 128)
    lone = space & (data != 0x20)
    lone[1:] &= ~space[:-1] | first[1:]
    after = lone[:-1] & ~space[1:]
    cut[1:] |= after
    return np.flatnonzero(cut)


def rows_with_wide_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space beyond ASCII, where the cuts of unit_starts may not hold."""
    at = np.flatnonzero(_LEAD[data])
    at = at[at + 1 < len(data)]
    if not len(at):
        return at
    two = data[at].astype(np.uint32) << 16 | data[at + 1].astype(np.uint32) << 8
    three = two | data[np.minimum(at + 2, len(data) - 1)]
    hit = np.isin(two, [int.from_bytes(s + b"\0", "big") for s in _WIDE_SPACES if len(s) == 2])
    hit |= np.isin(three, [int.from_bytes(s, "big") for s in _WIDE_SPACES if len(s) == 3])
    return np.unique(np.searchsorted(offsets, at[hit], "right") - 1)


def _cuts_hold(tokenizer) -> bool:
    """Whether a tokenizer is byte-level without a normalizer, so that units of unit_starts can be encoded apart."""
    parts = json.loads(tokenizer.to_str())
    pre = parts.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return bool(plain and not parts.get("normalizer") and parts["model"]["type"] == "BPE")


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind: type, first: list | None = None):
        self._held, self.n = np.zeros(1024, kind), 0
        self.add(np.array(first or [], kind))

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self._held):
            grown = np.zeros(max(2 * len(self._held), self.n + len(more)), self._held.dtype)
            grown[: self.n] = self._held[: self.n]
            self._held = grown
        self._held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self._held[: self.n]


_RAMP = np.arange(vec.SLAB + (1 << 16))


def _ramp(n: int) -> np.ndarray:
    """0 to n - 1; made anew for very long rows only."""
    return _RAMP[:n] if n <= len(_RAMP) else np.arange(n)


class UnitEncoder:
    """Encodes columns of texts with a ``tokenizers`` tokenizer as it is by default, each distinct unit once as long as the table isn't full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._by_units = _cuts_hold(self._tokenizer)
        self._forget(0)

    def _forget(self, units: int) -> None:
        """Empties the table, with slots for _FULL units, or for ``units`` if those are more."""
        slots = 1 << (2 * max(units, _FULL) - 1).bit_length()
        self._keys, self._slot_of = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        # of each entry: where its ids and its bytes begin, and how many there are; the last ones are the pools
        self._begin, self._length, self._ids = _Grown(np.int64), _Grown(np.int32), _Grown(np.int32)
        self._raw_begin, self._size, self._raw = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint8)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        found = np.full(len(hashes), -1, np.int64)
        open_, slot = np.arange(len(hashes)), (hashes & np.uint64(len(self._keys) - 1)).astype(np.int64)
        while len(open_):
            key = self._keys[slot]
            hit = key == hashes[open_]
            found[open_[hit]] = self._slot_of[slot[hit]]
            on = ~hit & (key != 0)
            open_, slot = open_[on], (slot[on] + 1) & (len(self._keys) - 1)
        return found

    def _insert(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        slot = (hashes & np.uint64(len(self._keys) - 1)).astype(np.int64)
        while len(hashes):
            free = self._keys[slot] == 0
            _, one = np.unique(slot, return_index=True)
            won = np.zeros(len(hashes), bool)
            won[one] = True
            won &= free
            self._keys[slot[won]], self._slot_of[slot[won]] = hashes[won], entries[won]
            hashes, entries, slot = hashes[~won], entries[~won], (slot[~won] + 1) & (len(self._keys) - 1)

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Adds units, a few thousand at a time: the library's results are large objects."""
        for lo in range(0, len(starts), _ASKED):
            units = [raw[a:b] for a, b in zip(starts[lo : lo + _ASKED].tolist(), ends[lo : lo + _ASKED].tolist(), strict=True)]
            found = [e.ids for e in self._tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)]
            entries = self._begin.n + np.arange(len(units))
            for begin, size, pool, parts in ((self._begin, self._length, self._ids, found), (self._raw_begin, self._size, self._raw, units)):
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                begin.add(pool.n + np.cumsum(sizes) - sizes)
                size.add(sizes)
                pool.add(np.frombuffer(b"".join(parts), np.uint8) if parts is units else np.fromiter((i for p in parts for i in p), np.int32, int(sizes.sum())))
            self._insert(hashes[lo : lo + _ASKED], entries.astype(np.int32))

    def _strange(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Units that aren't, byte for byte, those of their entries. Units stand side by side and cover ``data``."""
        size = ends - starts
        theirs = np.repeat(self._raw_begin.all[found] - starts, size)
        theirs += _ramp(len(data))
        (differ,) = np.nonzero(self._raw.all.take(theirs, mode="clip") != data)
        odd = np.flatnonzero(size != self._size.all[found])
        return odd if not len(differ) else np.union1d(odd, np.searchsorted(starts, differ, "right") - 1)

    def _rows_with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold the string of an added token."""
        raw, at = data.tobytes(), []
        for content in self._added:
            place = raw.find(content)
            while place >= 0:
                at.append(place)
                place = raw.find(content, place + 1)
        return np.unique(np.searchsorted(offsets, at, "right") - 1) if at else np.zeros(0, np.int64)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, offsets of the rows' ids, and rows that have to be encoded whole."""
        starts = unit_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = vec.word_hashes(data, starts, ends)
        hashes[hashes == 0] = 1
        found = self._find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, at = np.unique(hashes[new], return_index=True)
            if self._begin.n + len(keys) > _FULL:  # forget all, so that memory stays bounded; then each unit of the slab is new
                new = np.arange(len(hashes))
                keys, at = np.unique(hashes, return_index=True)
                self._forget(len(keys))
            at = new[at]
            self._learn(data.tobytes(), starts[at], ends[at], keys)
            found = self._find(hashes)
            assert (found >= 0).all(), "a unit without an entry"
        lengths = self._length.all[found].astype(np.int64)
        upto = np.cumsum(lengths)
        at = np.repeat(self._begin.all[found] - (upto - lengths), lengths)
        at += _ramp(len(at))
        ids = self._ids.all[at]
        bounds = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        strange = np.searchsorted(offsets, starts[self._strange(data, starts, ends, found)], "right") - 1
        odd = [strange, rows_with_wide_space(data, offsets), self._rows_with_added(data, offsets)]
        return ids, bounds, np.unique(np.concatenate(odd))

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slabs of rows as (first row, ids, offsets of the rows' ids)."""
        for row, data, offsets in vec.slabs(column):
            n = len(offsets) - 1
            if self._by_units:
                ids, bounds, odd = self._units(data, offsets)
            else:
                ids, bounds, odd = np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.arange(n)
            if len(odd):
                parts = np.split(ids, bounds[1:-1])
                for r in odd.tolist():
                    text = data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")
                    parts[r] = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield row, ids, bounds


@functools.lru_cache(2)
def _encoder(path: str) -> UnitEncoder:
    """A worker's encoder; it lasts from task to task."""
    return UnitEncoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by ``end_id``."""
    return np.insert(ids, bounds[1:], end_id).astype(np.int32), bounds + np.arange(len(bounds))


def _encode_rows(path: str, end_id: int):
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, ids, bounds in encoder.encode(batch.column("text")):
                ids, bounds = with_end(ids, bounds, end_id)
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n),
                        pa.array(np.full(n, part), pa.int32()),
                        pa.array(bounds[:-1] + at, pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                    ],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                at += int(bounds[-1])

    return run


def write_tokens(
    docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE
) -> str:
    """Writes the ids of all texts of ``docs`` (doc_id, text) to Parquet files under ``out``, and returns ``out``.

    ``encoding`` is "dictionary" or "delta" (DELTA_BINARY_PACKED). A null text counts as
    empty: the end id alone. Null doc_ids come first; rows with the same doc_id stay
    apart, ordered by a hash of the text. Other columns of ``docs`` are left out. An
    empty table writes files without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = ordered.select("doc_id", "text").mapInArrow(_encode_rows(tokenizer, end_id), "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
    (
        rows.write.option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_2_0")
        .mode("overwrite")
        .parquet(out)
    )
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files of write_tokens with ``start``, the number of ids of all documents before each one.

    Columns that a caller doesn't select aren't read; a filter on doc_id reads only pages that may hold it.
    """
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each file
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("before"))
    if len(rows.inputFiles()) <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of the lists of ids, from their Arrow buffer."""
    for batch in batches:
        ids = batch.column("ids")
        bounds, raw = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = write_tokens(docs, new_path(spark, "tokens"), tokenizer, **options)
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
