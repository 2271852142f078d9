"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus of a replay is the set of distinct chunks (see chunks.py) that a Python worker meets in a slice of texts and does not remember. All their
pieces are laid out in one token list; an inverted index leads from each token pair that merges to the positions where it occurs (pairs that merge
into the same token have the same rank and share an entry, or the leftmost would not go first). Ranks are then replayed in order, each over all its
positions at once, and only the neighbours that a merge touches are looked up again. What comes out is what the tiktoken library gives, as tests
check. Documents are then put together from their chunks, so a word costs merges once in a while and not once an occurrence.

One replay for all words of a table would need every occurrence of every word to go through a shuffle to its ids and back, which is several times
the texts; replaying a word in each worker costs less and needs no shuffle. Memory stays bounded by the slice and by chunks.REMEMBERED.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkMemory
from .common import field_list, lean, output_columns, ship, table, text_slices


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay(ChunkMemory):
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pieces = regex.compile(pattern).findall
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.width = max(ranks.values()).bit_length()
        # (left, right) -> what they merge into; two tokens merge whenever their bytes together are a token
        self.merge: dict[int, int] = {}
        for b, r in ranks.items():
            for i in range(1, len(b)):
                left, right = ranks.get(b[:i]), ranks.get(b[i:])
                if left is not None and right is not None:
                    self.merge[left << self.width | right] = r
        #: the same for two single bytes, -1 where they do not merge
        self.pairs = np.full((256, 256), -1, np.int64)
        for i in range(256):
            for j in range(256):
                self.pairs[i, j] = ranks.get(bytes([i, j]), -1)
        super().__init__(self.encode_chunks)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's ids begin in them; a word is what one match of the pattern gives."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths) - lengths
        n = len(data)
        tok = np.array(self.single, np.int64)[data]
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        filled = lengths > 0
        right[(begins + lengths - 1)[filled]] = -1
        left[begins[filled]] = -1
        # the index: what a merge gives -> the positions of its left token
        at = np.flatnonzero(right >= 0)
        rank = self.pairs[data[at], data[at + 1]]
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        where = {r: p.tolist() for r, p in zip(rank[cuts].tolist(), np.split(at, cuts[1:]))} if len(at) else {}
        tok, nxt, prv = tok.tolist(), right.tolist(), left.tolist()
        merge, width = self.merge.get, self.width
        heap = list(where)
        heapify(heap)
        while heap:
            r = heappop(heap)
            found = where.pop(r)
            found.sort()
            for p in found:
                q = nxt[p]
                if q < 0 or tok[p] < 0 or merge(tok[p] << width | tok[q]) != r:
                    continue  # an earlier merge has taken one of the two
                tok[p] = r
                tok[q] = -1
                after = nxt[p] = nxt[q]
                before = prv[p]
                if after >= 0:
                    prv[after] = p
                    new = merge(r << width | tok[after])
                    if new is not None:
                        if new in where:
                            where[new].append(p)
                        else:
                            where[new] = [p]
                            heappush(heap, new)
                if before >= 0:
                    new = merge(tok[before] << width | r)
                    if new is not None:
                        if new in where:
                            where[new].append(before)
                        else:
                            where[new] = [before]
                            heappush(heap, new)
        done = np.array(tok, np.int64)
        kept = np.concatenate(([0], np.cumsum(done >= 0)))
        return done[done >= 0], kept[np.append(begins, n)]

    def encode_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ChunkMemory wants to know: a chunk's ids are those of the pieces that the pattern finds in it."""
        pieces = list(map(self.pieces, new))
        number: dict[str, int] = {}
        for ps in pieces:
            for w in ps:
                number.setdefault(w, len(number))
        ids, begins = self.encode_words([w.encode("utf-8", "surrogatepass") for w in number])
        words = np.array([number[w] for ps in pieces for w in ps], np.int64)
        n = (begins[1:] - begins[:-1])[words]
        upto = np.concatenate(([0], np.cumsum(n)))
        flat = ids[np.repeat(begins[words] - upto[:-1], n) + np.arange(upto[-1])]
        return flat, upto[np.concatenate(([0], np.cumsum([len(ps) for ps in pieces])))]

    def decode(self, ids: list[int]) -> bytes | None:
        """The bytes of the ids; None if one of them is no id of the rank file."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            return None


_REPLAYS: dict[tuple[str, str], Replay] = {}


def replay_of(path: str, pattern: str) -> Replay:
    """One encoder a worker process, kept between its tasks."""
    if (path, pattern) not in _REPLAYS:
        _REPLAYS[path, pattern] = Replay(load_ranks(path), pattern)
    return _REPLAYS[path, pattern]


def _rank_file(rank_file: str | None, pattern: str | None) -> tuple[str, str]:
    if rank_file is None or pattern is None:
        import public_tokenizers

        rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return rank_file, pattern


def encode_documents(docs: DataFrame, text: str = "text", rank_file: str | None = None, pattern: str | None = None, out: str = "token_ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out`` array<int>: the BPE ids of the whole text; columns named in ``drop`` are left out.

    A null or empty text has no ids. Other columns stay as they are; one that is named like ``out`` is replaced. Rows are independent, so
    ties and repeated rows are simply encoded each.
    """
    rank_file, pattern = _rank_file(rank_file, pattern)
    ship(docs.sparkSession)
    keep = output_columns(docs, [out, *drop])
    fields = ", ".join(filter(None, [field_list(docs, keep), f"`{out}` array<int>"]))

    def run(batches):
        bpe = replay_of(rank_file, pattern)
        for b in batches:
            at = b.schema.get_field_index(text)
            for i, j in text_slices(b.column(at)):
                part = b.slice(i, j - i)
                ids, begins = bpe.encode(part.column(at))
                col = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [col], keep + [out])

    return docs.mapInArrow(lean(run), fields)


def decode_documents(tokens: DataFrame, ids: str = "token_ids", rank_file: str | None = None, pattern: str | None = None, out: str = "decoded") -> DataFrame:
    """Add ``out`` binary: the bytes that the ids stand for; null ids give no bytes, and a row with an id that the rank file lacks has null."""
    rank_file, pattern = _rank_file(rank_file, pattern)
    ship(tokens.sparkSession)
    keep = output_columns(tokens, [out])
    fields = field_list(tokens, keep)

    def run(batches):
        bpe = replay_of(rank_file, pattern)
        for b in batches:
            col = pa.array([bpe.decode(x or []) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [col], keep + [out])

    return tokens.mapInArrow(lean(run), f"{fields}, `{out}` binary")


def round_trip_digest(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one blank), decoded_sha256 (of the bytes decoded from the ids).

    One pass: encodes each whole text, decodes its ids again and keeps only the digests. Null text counts as empty; a null doc_id stays null. Repeated rows
    and rows of one doc_id are encoded each; texts of any length are encoded whole; further columns, whatever their names, are neither read nor returned; an empty table gives no rows.
    """
    rank_file, pattern = _rank_file(rank_file, pattern)
    ship(docs.sparkSession)

    def run(batches):
        bpe = replay_of(rank_file, pattern)
        said = {i: str(i) for i in bpe.bytes_of}
        for b in batches:
            texts, names = b.column(1), b.column(0)
            for i, j in text_slices(texts):
                n, shas, back = [], [], []
                flat, begins = bpe.encode(texts.slice(i, j - i))
                begins = begins.tolist()
                for k, end in zip(begins, begins[1:]):
                    ids = flat[k:end].tolist()
                    n.append(len(ids))
                    shas.append(hashlib.sha256(" ".join(map(said.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([names.slice(i, j - i), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digest(table(spark, sf_dir, "documents"))
