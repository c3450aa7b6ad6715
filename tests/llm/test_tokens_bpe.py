import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

from plumbline.llm import bpe, queries, tokens

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n", "  ", "a  b", "a \n b", "a\n\nb", "a\n\n", "don't we'll 'tis ''s", "x.\nY, z... !!", "a  b  c", "tab\t\tq \t r", "…’s — “q” 12ab 3.14",
    "日本語 テキスト 。です", "é" * 50, "😀 😀😀  😀", "\x1c \x1d", "end ", "\r\n\r\n x", "<|endoftext|> a", "a" * 3000, " " * 300 + "b", "İı ǅ ßẞ", "_under_score_ $1,000.00 #tag",
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType()), T.StructField("ids", T.StringType())])


@pytest.fixture(scope="module")
def rank_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(3, "\n", "x", "y"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_equal_the_library(spark):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for docs in (odd_docs(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        want, at = [], 0
        for doc, text in rows:
            ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
            want.append((doc, at, len(ids), crc_of(ids)))
            at += len(ids)
        got = [tuple(r) for r in tokens.token_digests(docs).collect()]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("full", [4, 300])
def test_a_full_table_of_units_loses_no_ids(monkeypatch, full):
    monkeypatch.setattr(tokens, "_FULL", full)
    monkeypatch.setattr(tokens.vec.slabs, "__defaults__", (2000,))  # many slabs, each with common words that earlier ones had
    rng = random.Random(2)
    common = ["the", "of", "and", "to", "in"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    encoder = tokens.UnitEncoder(P.path("byte_bpe_50k.json"))
    got = [ids[a:b].tolist() for _, ids, bounds in encoder.encode(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [encoder._tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def encoded(path, texts):
    encoder = tokens.UnitEncoder(path)
    return [ids[a:b].tolist() for _, ids, bounds in encoder.encode(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_stretches_of_one_hash_and_added_tokens(monkeypatch):
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    texts = [word, other, f"{other} {word}", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endof", "text|>", "x<|endoftext|", "<|startoftext|>"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(P.path(name))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoded(P.path(name), texts) == want
        with monkeypatch.context() as patched:  # all stretches share three hashes
            patched.setattr(tokens.vec, "word_hashes", lambda data, starts, ends: ((ends - starts) % 3 + 1).astype(np.uint64))
            assert encoded(P.path(name), texts) == want


def test_a_very_long_text(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(["word ", "Zahl7 ", "é\u00a0", "\n\n", "'s ", "x" * 50]) for _ in range(400_000))
    docs = spark.createDataFrame([(2, text), (1, "short"), (3, None), (2, text)], "doc_id long, text string")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [*library.encode(text, add_special_tokens=False).ids, 0]
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_digests(docs).collect()}
    assert (2, len(ids), crc_of(ids)) in got and len(got) == 3


def test_token_files_format(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for kind, word in (("dictionary", "DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = tokens.write_tokens(docs, f"file://{tmp_path}/{kind}", encoding=kind, row_group=64 << 10, page=4 << 10)
        files = sorted((tmp_path / kind).glob("part-*.parquet"))
        meta = pq.ParquetFile(files[0]).metadata
        column = meta.row_group(0).column(4)
        assert any(word in e for e in column.encodings)
        assert column.has_offset_index and column.has_column_index
        assert sum(pq.ParquetFile(f).num_row_groups for f in files) > len(files)
        ids = [d for f in files for d in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
        assert ids == sorted(ids)
        plan = tokens.read_tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
        assert "ids:array" not in plan
    with pytest.raises(ValueError):
        tokens.write_tokens(docs, str(tmp_path / "x"), encoding="plain")


def test_token_files_of_an_empty_table(spark):
    assert tokens.token_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def brute(enc, rows):
    out = []
    for doc, text in rows:
        blank = len(text or "") > 100_000 and not text.strip()  # too long a match for the library
        ids = enc._encode_single_piece(text) if blank else enc.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def long_texts():
    rng = random.Random(5)
    alphabet = ["word", " ", "  ", "\n", "'s", "'", "ll", "é", "12", "...", "\t", "日本", " a", "'re", " ", "😀"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(50, 900))) for _ in range(60)]
    return [*texts, "x" * 900, " " * 700, "ab " * 300, "\n" * 333 + "q", "'" * 400 + "ll"]


def test_chunks_equal_whole_texts(spark, rank_encoding):
    rows = [(i, t, None, None) for i, t in enumerate(long_texts())]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None), (0, rows[2][1], None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rank_encoding, [(r[0], r[1]) for r in rows])
    for chunk, overlap, long, far in ((64, 16, 10_000, (100, 30)), (100, 30, 200, (64, 16)), (256, 64, 0, (256, 64))):
        got = sorted((tuple(r) for r in bpe.encode_digests(docs, chunk=chunk, overlap=overlap, long=long, far=far).collect()), key=str)
        assert got == want


def test_the_query_cuts_texts_into_chunks(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    pieces = [len(bpe.cuts(t, P.PATTERN, bpe.CHUNK, bpe.OVERLAP)) for t in texts]
    assert sum(n > 1 for n in pieces) > 2 and sum(len(t) > bpe.CHUNK for t in texts) == sum(n > 1 for n in pieces)


def test_a_very_long_text_by_chunks(spark, rank_encoding):
    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "Zahl7 ", "é", "\n\n", "'s ", "日本"]) for _ in range(500_000))
    assert len(text) > bpe.LONG
    rows = [(1, text), (2, text), (3, " " * (bpe.LONG + 5)), (4, "short")]
    got = bpe.encode_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rank_encoding, rows)


def test_bpe_query_and_odd_texts(spark, rank_encoding):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(rank_encoding, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in queries.op7_bpe_chunks(spark, SF).collect()), key=str) == want
    odd = odd_docs(spark)
    assert sorted((tuple(r) for r in bpe.encode_digests(odd).collect()), key=str) == brute(rank_encoding, [(r.doc_id, r.text) for r in odd.collect()])
    assert bpe.encode_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_decode_is_the_inverse(rank_encoding):
    for text in ODD:
        ids = rank_encoding.encode_ordinary(text or "")
        assert bpe.decode(ids) == (text or "").encode()
