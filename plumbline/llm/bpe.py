"""Byte-level BPE encoding and decoding, by overlapping chunks.

A text is cut into chunks that overlap, each split into pre-tokens on its own. Where both
neighbours of an overlap begin a pre-token at the same place, and the character before it
isn't white space, the true pre-tokens of the whole text also begin there: the pattern only
looks to the right, so from a common start on both see the same, and up to it the earlier
chunk was right already. The text is cut at these places and the pieces are encoded apart.
Their ids and bytes, in order, are those of the whole text. The chunks of a text of at most
LONG characters stay in one task; those of a longer one are dealt over all tasks.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import vec
from plumbline.shared import durable

#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 1 << 13, 1 << 8
#: Characters of a text whose chunks stay in one task, at most; and of a chunk, and its overlap, of a longer one.
LONG, FAR_CHUNK, FAR_OVERLAP = 1 << 20, 1 << 16, 1 << 10
#: A pre-token's end is certain if so many characters of the chunk follow it: the longest alternative of fixed length has three.
SURE = 3
#: Characters of text in an Arrow batch of chunks.
_BATCH = 4 << 20
_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_NAMES = ["n_tokens", "ids_sha256", "decoded_sha256"]
_KINDS = [pa.int64(), pa.string(), pa.string()]
#: Of a text that is dealt out: a digest of 128 bits.
_KEY = ["r1", "r2"]


@functools.lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-pair encoding of a rank file, without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def pretoken_starts(text: str, pattern: str, last: bool) -> list[int]:
    """Where pre-tokens begin in a chunk, as far as what comes after the chunk can't change it."""
    limit = len(text) if last else len(text) - SURE
    starts = [0]
    for match in _pattern(pattern).finditer(text):
        if match.end() > limit:
            break
        starts.append(match.end())
    return starts


def resync(text: str, starts: list[int], lo: int, hi: int) -> list[int]:
    """The starts in [lo, hi) that follow a character other than white space."""
    return [s for s in starts if lo <= s < hi and s and not text[s - 1].isspace()]


def cuts(text: str, pattern: str, chunk: int, overlap: int) -> list[int]:
    """Where the pieces of a text begin. Chunks that don't meet in their overlap are split anew as one, from the last cut on."""
    found, tail = [0], set()
    for k in range(0, len(text), chunk):
        last = k + chunk >= len(text)
        part = text[k : k + chunk + overlap]
        starts = pretoken_starts(part, pattern, last)
        if k:
            common = tail.intersection(s for s in starts if 0 < s < overlap)
            if common:
                found.append(k + min(common))
            else:
                starts = [s + found[-1] - k for s in pretoken_starts(text[found[-1] : k + chunk + overlap], pattern, last)]
        tail = {s - chunk for s in resync(part, starts, chunk + 1, chunk + overlap)}
    return found


def _ordinary(text: str, bpe: tiktoken.Encoding, pattern: str) -> list[int]:
    """The ids of a piece. On a run of some 100,000 characters the library's matcher gives up; each match is then encoded by itself."""
    try:
        return bpe.encode_ordinary(text)
    except BaseException as e:
        if type(e).__name__ != "PanicException":
            raise
    return [i for match in _pattern(pattern).finditer(text) for i in bpe._encode_single_piece(match[0])]


def encode_text(text: str, bpe: tiktoken.Encoding, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a whole text, encoded in pieces."""
    if len(text) <= chunk:
        return _ordinary(text, bpe, pattern)
    at = [*cuts(text, pattern, chunk, overlap), len(text)]
    return [i for a, b in zip(at, at[1:], strict=False) for i in _ordinary(text[a:b], bpe, pattern)]


def _digests(ids: list[int], bpe: tiktoken.Encoding) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode_bytes(ids)).hexdigest()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


_CUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, r1 long, r2 long, k long, last boolean, chunk string"
_CUT_NAMES = ["doc_id", *_NAMES, *_KEY, "k", "last", "chunk"]
_CUT_KINDS = [pa.int64(), *_KINDS, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]


def _encoded(path: str, pattern: str, chunk: int, overlap: int, long: int, far: tuple[int, int]):
    """The digests of each text; of one longer than ``long`` characters its chunks, for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path, pattern)
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if len(text) <= long:
                    rows.append((doc, *_digests(encode_text(text, bpe, pattern, chunk, overlap), bpe), None, None, None, None, None))
                    continue
                key = np.frombuffer(xxhash.xxh3_128_digest(text.encode("utf-8", "replace")), np.int64).tolist()
                for k in range(0, len(text), far[0]):
                    part = text[k : k + sum(far)]
                    rows.append((doc, None, None, None, *key, k // far[0], k + far[0] >= len(text), part))
                    held += len(part)
                    if held >= _BATCH:
                        yield _batch(rows, _CUT_NAMES, _CUT_KINDS)
                        rows, held = [], 0
            yield _batch(rows, _CUT_NAMES, _CUT_KINDS)

    return run


def _starts(pattern: str, chunk: int, overlap: int):
    """Adds where the first and the last ``overlap`` characters of a chunk can be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail = [], []
            for text, last in zip(batch.column("chunk"), batch.column("last"), strict=True):
                text, last = text.as_py(), last.as_py()
                starts = pretoken_starts(text, pattern, last)
                head.append([s for s in starts if 0 < s < overlap])
                tail.append([s - chunk for s in resync(text, starts, chunk + 1, chunk + overlap)])
            lists = pa.list_(pa.int32())
            keep = [batch.column(c) for c in (*_KEY, "k", "last")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(head, lists), pa.array(tail, lists)], [*_KEY, "k", "last", "head", "tail"])

    return run


def _pieces(path: str, pattern: str, chunk: int):
    """Ids (as decimal text) and decoded bytes of the piece of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path, pattern)
        for batch in batches:
            counts, texts, raws = [], [], []
            for text, begin, end in zip(batch.column("chunk"), batch.column("begin"), batch.column("end"), strict=True):
                text, end = text.as_py(), end.as_py()
                ids = _ordinary(text[begin.as_py() : len(text) if end is None else end + chunk], bpe, pattern)
                counts.append(len(ids))
                texts.append(" ".join(map(str, ids)))
                raws.append(bpe.decode_bytes(ids))
            keep = [batch.column(c) for c in (*_KEY, "k")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(raws, pa.binary())], [*_KEY, "k", "n", "ids", "raw"])

    return run


_FAR_DIGESTS = f"r1 long, r2 long, {_DIGESTS}"
_FAR_NAMES, _FAR_KINDS = [*_KEY, *_NAMES], [pa.int64(), pa.int64(), *_KINDS]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole texts from their pieces, which come in order; only the running digests are held."""
    key, n, ids, raw, done = None, 0, hashlib.sha256(), hashlib.sha256(), []
    for batch in batches:
        for piece in batch.to_pylist():
            if (piece["r1"], piece["r2"]) != key:
                if key is not None:
                    done.append((*key, n, ids.hexdigest(), raw.hexdigest()))
                key, n, ids, raw = (piece["r1"], piece["r2"]), 0, hashlib.sha256(), hashlib.sha256()
            if n and piece["n"]:
                ids.update(b" ")
            ids.update(piece["ids"].encode())
            raw.update(piece["raw"])
            n += piece["n"]
    if key is not None:
        done.append((*key, n, ids.hexdigest(), raw.hexdigest()))
    yield _batch(done, _FAR_NAMES, _FAR_KINDS)


def _whole(path: str, pattern: str, chunk: int):
    """Digests of whole texts, put together from their chunks, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, key, parts, done = encoding(path, pattern), None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["r1"], row["r2"]) != key:
                    if key is not None:
                        done.append((*key, *_digests(encode_text("".join(parts), bpe, pattern), bpe)))
                    key, parts = (row["r1"], row["r2"]), []
                parts.append(row["chunk"][:chunk])
        if key is not None:
            done.append((*key, *_digests(encode_text("".join(parts), bpe, pattern), bpe)))
        yield _batch(done, _FAR_NAMES, _FAR_KINDS)

    return run


def _dealt(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id and digests) of the texts that came as chunks; each distinct text is encoded once, its copies take its digests."""
    dealt = rows.select(*_KEY, "k", "last", "chunk").dropDuplicates([*_KEY, "k"])
    order = Window.partitionBy(*_KEY).orderBy("k")  # a row for each chunk of one text
    cut = (
        dealt.mapInArrow(_starts(pattern, chunk, overlap), "r1 long, r2 long, k long, last boolean, head array<int>, tail array<int>")
        .select(*_KEY, "k", "last", "tail", F.lead("head").over(order).alias("next_head"))
        .select(*_KEY, "k", "last", F.array_min(F.array_intersect("tail", "next_head")).alias("end"))
        .select(*_KEY, "k", "last", "end", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("begin"))
        .withColumn("unsynced", F.max((F.col("end").isNull() & ~F.col("last")).cast("int")).over(Window.partitionBy(*_KEY)))
    )
    cut = durable(cut)
    pieces = (
        dealt.join(cut.filter("unsynced = 0").select(*_KEY, "k", "begin", "end"), [*_KEY, "k"])
        .select(*_KEY, "k", "chunk", "begin", "end")
        .mapInArrow(_pieces(path, pattern, chunk), "r1 long, r2 long, k long, n long, ids string, raw binary")
    )
    stitched = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "k").mapInArrow(_joined, _FAR_DIGESTS)
    odd = dealt.join(cut.filter("unsynced = 1 and k = 0").select(*_KEY), _KEY, "left_semi")
    unstitched = odd.repartition(*_KEY).sortWithinPartitions(*_KEY, "k").select(*_KEY, "chunk").mapInArrow(_whole(path, pattern, chunk), _FAR_DIGESTS)
    return rows.filter("k = 0").select("doc_id", *_KEY).join(stitched.unionByName(unstitched), _KEY).select("doc_id", *_NAMES)


def encode_digests(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, long: int = LONG, far: tuple[int, int] = (FAR_CHUNK, FAR_OVERLAP)
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs``.

    ``chunk`` and ``overlap`` count characters, and ``far`` has both for texts of more than
    ``long`` characters. A null text counts as empty: no ids, the digests of nothing. A
    null doc_id stays null; rows that repeat a doc_id or a text each give a row. Other
    columns of ``docs`` are not read, whatever their names. An empty table gives an empty
    result.
    """
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    for size, shared in ((chunk, overlap), far):
        if not SURE < shared < size:
            raise ValueError("the overlap is longer than the lookahead and shorter than a chunk")
    # written, as the chunks of long texts are read again while the digests of the others are done
    rows = durable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(vec.lean(_encoded(path, pattern, chunk, overlap, long, far)), _CUT))
    done = rows.filter("chunk is null").select("doc_id", *_NAMES)
    if rows.filter("chunk is not null").limit(1).count() == 0:
        return done
    return done.unionByName(_dealt(rows.filter("chunk is not null"), path, pattern, *far))


def decode(ids: np.ndarray | list[int], path: str | None = None, pattern: str | None = None) -> bytes:
    """The bytes that ids stand for, one after the other."""
    bpe = encoding(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    return bpe.decode_bytes(list(ids))
