"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every document's distinct shingles (runs of words) are hashed, and summed up in COORDINATES minima (its signature). Documents with equal shingle sets
   form a class at once, and of classes with equal signatures one is posted for all; one representative stands for each.
2. A (coordinate, minimum) pair is a token. Two documents that agree in MATCHES of COORDINATES minima share a token among the first
   COORDINATES - MATCHES + 1 of each, if all sort their tokens from the rarest on (prefix). Tokens of one document only need no list, and a document with fewer than MATCHES
   other tokens has no partner; long lists come last and are skipped.
3. Within a list, collisions of two documents are counted over all coordinates, and pairs that reach MATCHES are joined. Pairs that are joined already are skipped, so a list of g
   documents gives at most g - 1 pairs, however many are copies of each other. The pairs join documents in candidate clusters.
4. Every cluster is confirmed on full shingle sets, exactly.

Long lists (3) and large clusters (4) go in blocks of bounded size (see link_groups): all members meet one pivot, and only those that it does not join meet all others. So a family of
copies costs as many comparisons as it has members, and no task holds more than a block.

A pair at similarity 0.8 reaches 38 of 64 matches but for about 1 in 30,000; nothing is linked without its full sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_text, lean, output_columns, ship, spool, table, text_slices, unspool

COORDINATES, MATCHES = 64, 38
#: Words of a shingle, and the least similarity in percent. The query op8_minhash takes pairs of words, as its contract says.
SHINGLE, PERCENT = 5, 80
OP8_SHINGLE = 2
#: Rows of a list that are compared in one go, and shingles and rows of a cluster that are; longer lists and larger clusters go in blocks of that size.
LIST_ROWS, BLOCK_SHINGLES, BLOCK_ROWS = 512, 100_000, 256
#: Word hashes that a task remembers; beyond it the memory is emptied.
REMEMBERED = 200_000
SEED = 11

_MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 32, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


def shingles(text: str | None, size: int = SHINGLE, known: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``size`` words (A-Z lowered); all its words as one run if there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map((_WordHashes() if known is None else known).__getitem__, words), np.uint64, len(words))
    start = len(ids) if len(ids) < size else 0  # a short text as a whole is no shingle of another
    size = min(size, len(ids))
    h = np.full(len(ids) - size + 1, start, np.uint64)
    for i in range(size):
        h = (h ^ ids[i : len(ids) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(h: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The least of the hashes under each of ``coordinates`` multiplications, upper 32 bits."""
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    m = _MULTIPLIERS[:coordinates]
    for i in range(0, len(h), 512):
        np.minimum(least, (h[i : i + 512, None] * m).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def short(sig: bytes) -> bytes:
    """One byte for each coordinate, to count matches: minima that differ look equal now and then (1 in 256), equal ones always."""
    return np.frombuffer(sig, np.uint32).astype(np.uint8).tobytes()


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_hash (hex text, null for an empty set), sig (binary) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        known = _WordHashes()
        for b in batches:
            for i, j in text_slices(b.column(1)):
                n, sets, sigs = [], [], []
                for t in b.column(1).slice(i, j - i).to_pylist():
                    h = shingles(t, size, known)
                    n.append(len(h))
                    sets.append(xxhash.xxh128_hexdigest(h.tobytes()) if len(h) else None)
                    sigs.append(signature(h).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(sets, pa.string()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_hash", "sig"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(lean(run), "doc_id long, n_shingles long, set_hash string, sig binary")


def _postings(reps: DataFrame) -> DataFrame:
    """token, doc_id, sig (one byte a coordinate), length: every representative under the tokens of its prefix that others share; length is that of the token's list."""

    def tokens(batches):
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.int64)
                flat = (sig | (np.arange(COORDINATES, dtype=np.int64) << 32)).ravel()
                ends = np.arange(0, flat.size + 1, COORDINATES, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "tokens"])

    listed = reps.select("doc_id", "sig").mapInArrow(lean(tokens), "doc_id long, tokens array<bigint>").select("doc_id", F.explode("tokens").alias("token"))
    shared = spool(listed.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "minhash-tokens")
    mine = listed.join(shared, "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))  # COORDINATES at most
    mine = mine.where(F.size("tokens") >= MATCHES).select("doc_id", F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1)).alias("tokens"))
    posted = mine.select("doc_id", F.explode("tokens").alias("t")).select("doc_id", F.col("t.token").alias("token"))
    posted = spool(posted, "minhash-prefixes")
    unspool(shared)
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1")

    def shorten(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([short(x) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "sig"])

    sigs = reps.select("doc_id", "sig").mapInArrow(lean(shorten), "doc_id long, sig binary")
    out = spool(posted.join(lists, "token").join(sigs, "doc_id").select("token", "doc_id", "sig", "length"), "minhash-lists")
    unspool(posted)
    return out


def _groups(batches, columns: list[str]):
    """Rows sorted by ``columns`` as tables of whole groups, many groups at a time, with the group keys as a matrix."""
    rest: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in columns], axis=1)
        t = pa.Table.from_batches([b])
        cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        starts_new = last is not None and (key[0] != last).any()
        last = key[-1]
        if not len(cut):
            if starts_new:
                yield from _whole(rest, columns)
                rest = []
            rest.append(t)
            continue
        yield from _whole([*rest, t.slice(0, cut[-1])], columns)
        rest = [t.slice(cut[-1])]
    yield from _whole(rest, columns)


def _whole(tables: list, columns: list[str]):
    if tables:
        t = pa.concat_tables(tables)
        yield t, np.stack([t.column(c).to_numpy() for c in columns], axis=1)


def _short_lists(posted: DataFrame) -> DataFrame:
    """a, b: of every list of at most LIST_ROWS documents, pairs with MATCHES collisions, as many as join all that such pairs join. All lists of a batch go together."""

    def run(batches):
        for t, key in _groups(batches, ["token"]):
            ids = t.column("doc_id").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            first = np.concatenate(([True], (key[1:] != key[:-1]).any(1)))
            end = np.append(np.flatnonzero(first), len(key))[np.cumsum(first)]  # of the row's list
            label = np.arange(len(key))
            found = []
            row, lag = np.arange(len(key)), 1
            while True:  # pairs of rows at a distance of ``lag``, all lists at once
                row = row[row + lag < end[row]]
                if not len(row):
                    break
                for s in range(0, len(row), 8192):
                    i = row[s : s + 8192]
                    i = i[label[i] != label[i + lag]]
                    i = i[(sig[i] == sig[i + lag]).sum(1) >= MATCHES]
                    for a, b in zip(i.tolist(), (i + lag).tolist()):
                        la, lb = label[a], label[b]
                        if la != lb:
                            found.append((ids[a], ids[b]))
                            lo, hi = np.searchsorted(end, end[a]), end[a]  # ends ascend, so this is the list
                            part = label[lo:hi]
                            part[part == lb] = la
                lag += 1
            if found:
                f = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f.min(1)), pa.array(f.max(1))], ["a", "b"])

    return posted.select("token", "doc_id", "sig").repartition("token").sortWithinPartitions("token", "doc_id").mapInArrow(lean(run), "a long, b long")


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """(row, row) pairs that join what link[i, j] (of row left[i] and row right[j]) joins; rows with the same label are joined already. Labels are brought up to date."""
    out = []
    for i, r in enumerate(left.tolist()):
        to = right[link[i]]
        labels, at = np.unique(label[to], return_index=True)
        for other, k in zip(labels.tolist(), at.tolist()):
            if other != label[r]:
                out.append((r, int(to[k])))
                label[label == other] = label[r]
    return out


def link_groups(rows: DataFrame, linked: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """a, b: pairs that join all members of a group that are joined by links between its members, from (key long, doc_id long, payload binary, members long, n_blocks int).

    ``linked`` says of payloads and two lists of rows which of them are linked, as a matrix. A group is dealt into its ``n_blocks`` blocks by a hash. One member, the pivot, goes to all of
    them. In its block, every member is compared with the pivot; those that are not linked with it (open) are compared with all of the block. Then open members alone go to the
    other blocks, dealt into blocks themselves, and are compared with all members there. No pair is left out but those that are joined through the pivot.
    """
    own = F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int")
    pivots = rows.where("n_blocks > 1").groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(SEED), F.col("doc_id")).alias("h"), F.col("doc_id"), F.col("payload"))).alias("p"), F.first("n_blocks").alias("n_blocks"))
    pivots = pivots.select("key", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("p.doc_id").alias("doc_id"), F.col("p.payload").alias("payload"))
    members = rows.select("key", own.alias("block"), F.when(F.col("n_blocks") > 1, 2).otherwise(1).alias("role"), "doc_id", "payload")

    def first(batches):
        for t, key in _groups(batches, ["key", "block"]):
            ids, role = t.column("doc_id").to_numpy(), t.column("role").to_numpy()
            keys, as_, bs = [], [], []
            for i, j in _cuts(key):
                if j - i > 1:
                    payloads = t.column("payload").slice(i, j - i).to_pylist()
                    every = np.arange(j - i)
                    label = every.copy()
                    pairs = _forest(linked(payloads, every[:1], every[1:]), every[:1], every[1:], label)
                    open_ = every[1:][(label[1:] != label[0]) & (ids[i + 1 : j] != ids[i])]
                    if role[i] == 0:
                        keys += [key[i, 0]] * len(open_)
                        as_ += ids[i + open_].tolist()
                        bs += [None] * len(open_)
                    if len(open_):
                        pairs += _forest(linked(payloads, open_, every), open_, every, label)
                    pairs = [(ids[i + a], ids[i + b]) for a, b in pairs if ids[i + a] != ids[i + b]]
                    keys += [key[i, 0]] * len(pairs)
                    as_ += [min(x) for x in pairs]
                    bs += [max(x) for x in pairs]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(as_, pa.int64()), pa.array(bs, pa.int64())], ["key", "a", "b"])

    met = pivots.unionByName(members).repartition("key", "block").sortWithinPartitions("key", "block", "role", "doc_id").mapInArrow(lean(first), "key long, a long, b long")
    met = spool(met, "minhash-met")

    open_ = met.where("b IS NULL").select("key", F.col("a").alias("doc_id"))
    asking = open_.groupBy("key").agg(F.count(F.lit(1)).alias("open"))
    large = rows.where("n_blocks > 1").join(asking, "key").join(open_.withColumn("is_open", F.lit(True)), ["key", "doc_id"], "left")
    large = large.withColumn("n_asking", F.ceil(F.col("open") * F.col("n_blocks") / F.col("members")).cast("int"))
    is_open = F.coalesce("is_open", F.lit(False))
    stay = large.select("key", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("n_asking") - 1)).alias("asking"), F.lit(False).alias("asks"), is_open.alias("is_open"), "doc_id", "payload")
    other = F.filter(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: b != own)
    go = large.where("is_open").select("key", F.explode(other).alias("block"), F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("n_asking")).cast("int").alias("asking"), F.lit(True).alias("asks"), F.lit(True).alias("is_open"), "doc_id", "payload")

    def second(batches):
        for t, key in _groups(batches, ["key", "block", "asking"]):
            ids, asks, still = t.column("doc_id").to_numpy(), t.column("asks").to_numpy(), t.column("is_open").to_numpy()
            found = []
            for i, j in _cuts(key):
                left, right = np.flatnonzero(asks[i:j]), np.flatnonzero(~asks[i:j])
                if len(left) and len(right):
                    label = np.where(still[i:j], np.arange(j - i), -1)  # what is not open is joined through the pivot
                    payloads = t.column("payload").slice(i, j - i).to_pylist()
                    found += [(ids[i + a], ids[i + b]) for a, b in _forest(linked(payloads, left, right), left, right, label) if ids[i + a] != ids[i + b]]
            if found:
                f = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f.min(1)), pa.array(f.max(1))], ["a", "b"])

    across = stay.unionByName(go).repartition("key", "block", "asking").sortWithinPartitions("key", "block", "asking", "asks", "doc_id").mapInArrow(lean(second), "a long, b long")
    out = spool(met.where("b IS NOT NULL").select("a", "b").unionByName(across).distinct(), "minhash-joined")
    unspool(met)
    return out


def _cuts(key: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.append(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))), len(key)).tolist()
    return list(zip(cuts, cuts[1:]))


def _collide(sigs: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows collide in MATCHES coordinates."""
    sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, COORDINATES)
    a, b = sig[left], np.ascontiguousarray(sig[right].T)
    count = np.zeros((len(left), len(right)), np.uint8)
    for c in range(COORDINATES):
        count += a[:, c, None] == b[None, c]
    return count >= MATCHES


def _similar(sets: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows are similar by PERCENT, from their full sets (sorted 64-bit hashes)."""
    at = np.union1d(left, right)
    own = [np.frombuffer(sets[i], np.uint64) for i in at.tolist()]
    sizes = np.array([len(x) for x in own], np.int64)
    place = np.searchsorted(at, left), np.searchsorted(at, right)
    if len(left) == 1:  # a pivot
        pivot = own[place[0][0]]
        common = np.array([[(pivot[np.minimum(np.searchsorted(pivot, x), len(pivot) - 1)] == x).sum() for x in (own[k] for k in place[1].tolist())]], np.int64)
    else:
        owner = np.repeat(np.arange(len(own)), sizes)
        _, code, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        keep = times[code] > 1  # a shingle of one document only adds to no intersection
        code, owner = code[keep], owner[keep]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        dense = np.cumsum(np.concatenate(([0], np.diff(code) != 0))) if len(code) else code
        shared = np.zeros((len(left), len(right)), np.float32)  # exact: counts stay far below 2**24
        for c in range(0, int(dense[-1]) + 1 if len(dense) else 0, 4096):
            i, j = np.searchsorted(dense, [c, c + 4096])
            m = np.zeros((len(own), 4096), np.float32)
            m[owner[i:j], dense[i:j] - c] = 1
            shared += m[place[0]] @ m[place[1]].T
        common = shared.astype(np.int64)
    return 100 * common >= PERCENT * (sizes[place[0]][:, None] + sizes[place[1]][None, :] - common)


def _candidates(posted: DataFrame) -> DataFrame:
    """a, b: pairs with MATCHES collisions, as many as join all that such pairs join."""
    blocks = F.ceil(F.col("length") / LIST_ROWS).cast("int")
    long = posted.where(F.col("length") > LIST_ROWS).select(F.col("token").alias("key"), "doc_id", F.col("sig").alias("payload"), F.col("length").alias("members"), blocks.alias("n_blocks"))
    return _short_lists(posted.where(F.col("length") <= LIST_ROWS)).unionByName(link_groups(long, _collide)).distinct()


def _confirm(clusters: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """a, b: documents (doc_id) of a cluster (doc_id, cluster, n: shingles) that are joined by links on full sets. Only texts of clustered documents are read for their sets; a block holds about
    BLOCK_SHINGLES shingles or BLOCK_ROWS rows, whichever is reached first."""
    total = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("n_blocks"))
    mine = clusters.join(total, "cluster").select(F.col("doc_id").alias("_id"), F.col("cluster").alias("key"), "members", "n_blocks")
    # one plan at every size: texts are dealt by doc_id once and not sorted, the clustered ids of a partition are its hash table
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(mine.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select("text", "doc_id", "key", "members", "n_blocks")

    def sets_of(batches):
        known = _WordHashes()
        for b in batches:
            for i, j in text_slices(b.column(0), 1 << 19):
                part = b.slice(i, j - i)
                sets = [shingles(t, size, known).tobytes() for t in each_text(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *part.columns[1:]], ["payload", "doc_id", "key", "members", "n_blocks"])

    sets = spool(texts.mapInArrow(lean(sets_of), "payload binary, doc_id long, key long, members long, n_blocks int"), "minhash-sets")
    out = link_groups(sets, _similar)
    unspool(sets)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that can be reached, for every node of the links (a, b). Alternates large-star and small-star steps until nothing changes."""
    edges = spool(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # larger neighbours to the least
        large = large.distinct()
        # small-star: a node and its smaller neighbours to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, spool(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        unspool(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v"))).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of equal sets, so also repeated rows, share a component. A doc_id names a
    document: rows that repeat it with other texts are looked at with one of these texts beyond the equality of sets. Rows without doc_id have no component and are kept.
    """
    rows = spool(sketch(docs, size), "minhash-sketch")
    classes = rows.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = spool(classes, "minhash-classes")
    # a set can only be like a larger one if one more shingle leaves it similar: sets of 4 and more, at 80 %
    reps = classes.where(F.col("n") * (100 - PERCENT) >= PERCENT).select("doc_id", "n", "sig")
    alike = reps.groupBy("sig").agg(F.min("doc_id").alias("leader"))
    led = reps.join(alike, "sig").where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    posted = _postings(alike.select(F.col("leader").alias("doc_id"), "sig"))
    candidates = components(_candidates(posted).unionByName(led))
    unspool(posted)
    clusters = spool(candidates.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(reps.select("doc_id", "n"), "doc_id"), "minhash-clusters")
    confirmed = _confirm(clusters, docs.select("doc_id", "text"), size)
    joined = components(confirmed)
    unspool(clusters, confirmed)

    classes = classes.select("set_hash", F.col("doc_id").alias("rep")).join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(F.col("set_hash").alias("_set"), F.coalesce("component", "rep").alias("_component"))
    found = rows.join(classes, rows["set_hash"] == F.col("_set"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each group (that with the smallest doc_id), with the columns of ``docs``. Rows that repeat a kept doc_id all stay."""
    gone = near_duplicates(docs, size).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    names = output_columns(docs, [])
    stay = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*names)
    return stay


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), OP8_SHINGLE)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
                               ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n_shingles + nb.n_shingles - c)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reached = u.a)
SELECT doc_id, n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept
FROM r JOIN n USING (doc_id) GROUP BY doc_id, n_shingles
"""
