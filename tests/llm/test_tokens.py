"""BPE and token files against the tiktoken and tokenizers libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.llm import bpe, chunks, token_orc

ODD = ["", " ", "  ", "a  b", "a\n b", "a \n b ", " x", " \tx y z    q", "don't you'll  I'm\r\n\r\n ok ", "aaaa aaaaaaaaa", "日本 語　テキスト 🙂 🙂🙂", "\x1c a \x85b \xa0c", "\n", "word " * 3000, "x" * 5000, "<|endoftext|> is text", "hello <|endoftext|> world", "a  <|endoftext|>  b<|endoftext|>"]


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.fixture(scope="module")
def replay():
    return bpe.replay_of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def ids_of(memory, texts):
    flat, begins = memory.encode(texts)
    return [flat[i:j].tolist() for i, j in zip(begins, begins[1:])]


def test_odd_texts_encode_as_the_libraries_do(encoding, replay):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [encoding.encode_ordinary(x) for x in ODD]
    assert ids_of(replay, [*ODD, None]) == [*want, []]
    assert ids_of(token_orc.encoder_of(P.path("byte_bpe_50k.json")), [*ODD, None]) == [*(e.ids for e in t.encode_batch(ODD, add_special_tokens=False)), []]
    assert [replay.decode(x).decode() for x in want] == ODD


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\t.,'sé日 \x1c\x85 x9")), max_size=40))
def test_any_text(encoding, replay, text):
    assert ids_of(replay, [text]) == [encoding.encode_ordinary(text)]
    parts = chunks.split(text)
    assert " ".join(parts) == text


def test_memory_may_be_forgotten(encoding, monkeypatch):
    monkeypatch.setattr(chunks, "REMEMBERED", 3)
    own = bpe.Replay(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    for text in ("one two three four five", "six seven one two", "one two three four five"):
        assert ids_of(own, [text]) == [encoding.encode_ordinary(text)]


def test_memory_is_bounded_where_texts_have_no_blanks(encoding, monkeypatch):
    monkeypatch.setattr(chunks, "REMEMBERED_CHARACTERS", 100)
    own = bpe.Replay(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    for i in range(20):
        text = f"{i}日本語" * 10
        assert ids_of(own, [text]) == [encoding.encode_ordinary(text)]
        assert own.characters <= 100 + len(text) and sum(map(len, own.first)) <= 100 + len(text)


def test_op10_on_the_small_table(spark, small, encoding):
    from docweave.llm.bpe import op10_byte_bpe

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op10_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encode_and_decode_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "k", [9]), (None, None, None, None), (1, "hello world", "k", [9])], "doc_id long, text string, n_tokens string, token_ids array<int>")
    enc = bpe.encode_documents(df)
    assert enc.columns == ["doc_id", "text", "n_tokens", "token_ids"]
    got = bpe.decode_documents(enc).collect()
    assert sorted((r["decoded"].decode(), len(r["token_ids"])) for r in got) == [("", 0), ("hello world", 2), ("hello world", 2)]
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_op9_reads_back_what_the_library_gives(spark, small):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    rows = sorted(token_orc.op9_token_orc(spark, small).collect(), key=lambda r: r["doc_id"])
    start = 0
    for (k, text), r in zip(docs, rows, strict=True):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_added_tokens_in_texts_are_those_of_the_plain_call(spark, tmp_path):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "a  <|endoftext|>", "<|endoftext|>\n<|endoftext|> x", "hello world"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    got = token_orc.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["token_ids"] for r in got} == {k: t.encode(x, add_special_tokens=False).ids + [0] for k, x in enumerate(texts)}


def test_unknown_ids_decode_to_null(spark):
    df = spark.createDataFrame([([31373, 995],), ([31373, 999_999],), (None,)], "token_ids array<int>")
    assert [r["decoded"] for r in bpe.decode_documents(df).collect()] == [b"hello world", None, b""]


def test_lookups_skip_files_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"))
    token_orc.write_tokens(docs, path, files=2)
    found = token_orc.lookup(spark, path, [7])
    assert "In(doc_id" in found._jdf.queryExecution().toString() or "EqualTo(doc_id,7)" in found._jdf.queryExecution().toString()
    assert found.count() == 1
    read = found._jdf.queryExecution().executedPlan()
    rows = found.select("doc_id", "token_ids")
    rows.collect()
    scanned = [m.value() for m in _metrics(rows, "numOutputRows")]
    assert read is not None and min(scanned) < 40_000 / 4, scanned  # row groups of 1,000 rows whose ranges or Bloom filters rule the id out are not read


def _metrics(df, name):
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return [leaves.apply(i).metrics().apply(name) for i in range(leaves.size()) if leaves.apply(i).metrics().contains(name)]


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame([(5, "b c"), (None, "n"), (2, None), (5, "b c"), (9, "x " * 4000)], "doc_id long, text string")
    path = str(tmp_path / "t")
    token_orc.write_tokens(df, path, files=3)
    assert [r["token_ids"] for r in token_orc.lookup(spark, path, [2, 77]).collect()] == [[0]]
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_orc.digest(spark, path).collect())
    assert [r[2] for r in rows] == [None, 2, 5, 5, 9] and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))
    files = [p for p in (tmp_path / "t").glob("*.orc")]
    import pyarrow.orc as orc

    mins = sorted(min(x for x in orc.read_table(p, columns=["doc_id"]).column(0).to_pylist() if x is not None) for p in files if orc.ORCFile(p).nrows and any(x is not None for x in orc.read_table(p, columns=["doc_id"]).column(0).to_pylist()))
    assert mins == sorted(set(mins))
    empty = str(tmp_path / "e")
    token_orc.write_tokens(df.limit(0), empty)
    assert token_orc.digest(spark, empty).count() == 0
