"""Token ids as ORC files.

Each document is a row (doc_id, token_ids array<int>, ...) in a file set that is sorted by doc_id. ORC stores the ids with its integer
run-length encoding, keeps minima and maxima of doc_id for every stripe and row group, and Bloom filters on doc_id, so that readers
split the files by stripes and look up documents without reading the rest.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkMemory
from .common import lean, shared_dir, ship, spool, table, text_slices

END_ID = 0

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.compress": "SNAPPY",
}


class Encoder(ChunkMemory):
    """The tokenizers library over distinct chunks: a chunk that occurs again is not encoded again (see chunks.py for why this gives the same ids)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt out the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # byte-level vocabularies write one character for each byte
        self.bytes_in = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for word, i in self.tokenizer.get_vocab().items():
            self.bytes_in[i] = len(word)
        # the library finds added tokens before it splits a text, so texts that hold one are encoded whole
        super().__init__(self.encode_chunks, tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))

    def encode_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A chunk that begins with its blank may follow any other without changing its ids, so many are encoded as one text; the others alone."""
        groups: list[list[str]] = []
        for k, c in enumerate(new):
            if len(c) > 1 and c[0] == " " and not c[1].isspace() and groups and k % 512 and not any(w in c for w in self.whole):
                groups[-1].append(c)
            else:
                groups.append([c])
        texts = ["".join(g) for g in groups]
        ids = [np.array(e.ids, np.uint32) for i in range(0, len(texts), 32) for e in self.tokenizer.encode_batch_fast(texts[i : i + 32], add_special_tokens=False)]
        ids = np.concatenate(ids)
        upto = np.concatenate(([0], np.cumsum(self.bytes_in[ids])))
        ends = np.concatenate(([0], np.cumsum([len(c.encode()) for c in new])))
        begins = np.searchsorted(upto, ends)
        if begins[-1] != len(ids) or not np.array_equal(upto[begins], ends):
            raise ValueError("a token reaches across a place where texts are cut")
        return ids, begins


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer_file: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """doc_id long, token_ids array<int>: the ids of the whole text (null: empty), then ``end_id`` (none if None). Rows keep their order within partitions.

    Ids are those of the library's plain call: the string of an added token in a text (as <|endoftext|>) is that token.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)

    def run(batches):
        own = encoder_of(tokenizer_file)
        for b in batches:
            texts = b.column(1)
            for i, j in text_slices(texts):
                ids, begins = own.encode(texts.slice(i, j - i))
                if end_id is not None:
                    ids, begins = np.insert(ids, begins[1:], end_id), begins + np.arange(len(begins))
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], ["doc_id", "token_ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(lean(run), "doc_id long, token_ids array<int>")


def write_tokens(docs: DataFrame, path: str, files: int | None = None, **how) -> None:
    """Tokenize ``docs`` and write them to ``path`` in ascending doc_id order: file ``part`` p holds smaller ids than file p + 1.

    Texts are dealt into ranges of doc_id and sorted before they are encoded, so that encoding runs once and nothing is shuffled after it.
    ``part`` is the number of the range. Rows of one doc_id stay together; a null doc_id sorts first. An empty table writes no rows.
    """
    few = docs.select("doc_id", "text")
    ordered = few.repartitionByRange(files, "doc_id") if files else few.repartitionByRange("doc_id")
    tokens = tokenize(ordered.sortWithinPartitions("doc_id"), **how)
    tokens.withColumn("part", F.spark_partition_id()).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, token_ids array<int>, part int").orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Documents by id: the filter goes to the reader, which skips stripes and row groups by their minima, maxima and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin([int(i) for i in ids]))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a written file set; start counts the ids of all documents before it.

    Starts are a prefix sum in two steps, so no task sees more than one file: sums of the files are added up first (one row a file),
    then each file adds up its own documents. Repeated doc_ids follow each other in an order fixed by their own content.
    """
    ship(spark)

    def run(batches):
        for b in batches:
            col = b.column(1)
            ends = np.asarray(col.offsets)
            flat = np.ascontiguousarray(np.asarray(col.values), dtype="<u4")
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), b.column(2)], ["doc_id", "n_tokens", "ids_crc32", "part"])

    # a few numbers a document, read from the files once and used twice
    return with_starts(spool(read_tokens(spark, path).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_crc32 long, part int"), "token-digests"))


def with_starts(each: DataFrame) -> DataFrame:
    sums = each.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    before = sums.select(F.col("part").alias("_part"), (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_before"))
    inside = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return (
        each.withColumn("_upto", F.sum("n_tokens").over(inside))
        .join(before, F.col("part") == F.col("_part"))
        .select("doc_id", (F.col("_before") + F.col("_upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/token-orc-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digest(spark, path)
