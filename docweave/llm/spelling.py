"""Spelling variants by suffix-rank intervals: words at one edit from each other, and the frequent form that each rare one stands for.

Two words at one edit agree exactly in one half: cut the shorter one (length n) after n // 2 code points; the edit lies in front of that cut or behind it. So every word
is posted under both halves, once as a word of its own length and once as the longer partner of a word one shorter; words that share a half meet in one task. There they are
the delimited vocabulary of an index (the two directions of a bidirectional FM-index: one over the words, one over the reversed words; as each half hangs on a delimiter, a
search only ever extends away from it and carries the interval of that direction alone). A search matches its half exactly, then extends across the other half and spends
its one error: another code point, or one more. Intervals that hold nothing but the word itself end at once.

The search is in numpy, all words of a chunk step by step together: ranks are binary searches in one sorted array of (code, position). A half that more than GROUP_WORDS words share is
dealt out: each part indexes its share, all words of the half search in every part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_text, ship, spool, table, unspool

#: Contract: letters of a run, least length of a word, least occurrences, how much more frequent a form is, and one in how many runs loses a code point.
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = 7, 2, 10, 31
RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
#: Entries of a task's table of counts, words of an index, words that search together, words that share a half before it is dealt out.
COUNTED_TOGETHER, INDEX_WORDS, SEARCHED_TOGETHER, GROUP_WORDS = 300_000, 60_000, 8_192, 60_000


def damaged(doc_id: object, word: str, every: int = DAMAGED) -> str:
    """The lower-cased run as the contract counts it: h is the crc32 of ``<doc_id>:<run>``; if ``every`` divides h, the code point h % length is missing. A null doc_id is the empty text."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    i = h % len(word)
    return word[:i] + word[i + 1 :] if h % every == 0 else word


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words (doc_id, text) that occur at least ``least`` times in all texts. Counts meet as partial sums by word, a task sends a word once for each table of COUNTED_TOGETHER entries that it fills."""
    ship(docs.sparkSession)

    def count(batches):
        counts = Counter()

        def out():
            words = list(counts)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], ["word", "n"])
            counts.clear()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), each_text(b.column(1))):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # one match after another, so a text of any length is never held as a list of its runs
                for run, n in Counter(m[0] for m in RUNS.finditer(text)).items():
                    raw = run.encode().lower()  # bytes: A-Z only
                    h = zlib.crc32(raw, start)
                    word = raw.decode()
                    if h % DAMAGED == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    counts[word] += n
                if len(counts) >= COUNTED_TOGETHER:
                    yield from out()
        yield from out()

    found = docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class SuffixRanks:
    """An FM-index over distinct words, each ended by a delimiter of its own: intervals of suffix ranks, extended to the left.

    Row r is the r-th smallest suffix. Suffixes of different words are never equal, as delimiters sort by word. ``keys`` holds code * (rows + 1) + rank of every row's
    preceding code (0 where the word begins), so how often a code precedes the rows below i is one binary search.
    """

    def __init__(self, words: list[str]):
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet, dense = np.unique(points, return_inverse=True)
        self.codes = dense.astype(np.int64) + 1
        self.starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        n = len(words)
        rows = int(lengths.sum()) + n
        # text: the words with a place for the delimiter behind each; a delimiter ranks by its word, before all codes
        at = np.arange(len(self.codes)) + np.repeat(np.arange(n), lengths)
        ends = np.cumsum(lengths + 1) - 1
        rank = np.empty(rows, np.int64)
        rank[at] = self.codes + n
        rank[ends] = np.arange(n)
        step, last = 1, np.arange(rows)
        while True:  # suffixes sorted by twice as many codes each time; beyond a delimiter nothing is left to tell
            key = rank * (rows + n + 1 + len(self.alphabet)) + rank[np.minimum(last + step, rows - 1)]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            rank[order] = new
            if new[-1] == rows - 1:
                break
            step *= 2
        text = np.zeros(rows, np.int64)
        text[at] = self.codes
        before = np.concatenate(([0], text[:-1]))  # what stands in front: 0 at the beginning of a word
        self.before = before[order]
        self.rows, self.sigma, self.words = rows, len(self.alphabet) + 1, n
        keys = self.before * (rows + 1) + np.arange(rows)
        self.keys = np.sort(keys)
        self.below = np.searchsorted(self.keys, np.arange(self.sigma) * (rows + 1))  # places in keys where a code begins
        counts = np.bincount(text[at], minlength=self.sigma)
        counts[0] = n
        self.first = np.concatenate(([0], np.cumsum(counts)))[:-1]  # rows whose suffix begins with a smaller code
        self.word_of = np.repeat(np.arange(n), lengths + 1)[order]

    def extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that begin with ``code`` and go on as those in lo..hi."""
        base, shift = code * (self.rows + 1), self.first[code] - self.below[code]
        return np.searchsorted(self.keys, base + lo) + shift, np.searchsorted(self.keys, base + hi) + shift

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, words) where one of the rows in lo..hi is a whole word."""
        i = np.searchsorted(self.keys, lo)  # code 0
        row = self.keys[np.minimum(i, len(self.keys) - 1)]
        hit = np.flatnonzero((i < self.below[1] if self.sigma > 1 else True) & (row < hi) & (row >= lo))
        return hit, self.word_of[row[hit]]

    def preceding(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, codes): the codes that may stand before the rows in lo..hi. Small intervals are looked through, for large ones every code is named."""
        size = hi - lo
        small, large = np.flatnonzero(size <= self.sigma), np.flatnonzero(size > self.sigma)
        n = size[small]
        rows = np.repeat(lo[small] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
        both = np.unique(np.repeat(small, n) * self.sigma + self.before[rows])
        state, code = both // self.sigma, both % self.sigma
        state = np.concatenate((state, np.repeat(large, self.sigma - 1)))
        code = np.concatenate((code, np.tile(np.arange(1, self.sigma), len(large))))
        return state[code > 0], code[code > 0]

    def one_error(self, queries: list[str], exact: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs: words that end in the last ``exact`` code points of the query and differ by one replaced or one more code point in front of them. ``own``: whether the query is a word of the index too."""
        lengths = np.array([len(q) for q in queries], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        points = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32)
        place = np.searchsorted(self.alphabet, points)
        known = place < len(self.alphabet)
        known[known] = self.alphabet[place[known]] == points[known]
        codes = np.where(known, place + 1, 0)  # 0: no word holds it
        q = np.arange(len(queries))
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.words, np.int64)  # the closing delimiters
        for i in range(int(exact.max(initial=0))):
            on = np.flatnonzero(exact[q] > i)
            code = codes[starts[q[on]] + lengths[q[on]] - 1 - i]
            lo[on], hi[on] = self.extend(code, lo[on], hi[on])
            hi[on[code == 0]] = lo[on[code == 0]]
            keep = hi - lo > own[q]
            q, lo, hi = q[keep], lo[keep], hi[keep]
        left = (lengths - exact)[q]  # code points still to match
        used = np.zeros(len(q), bool)
        found_q, found_w = [], []
        while len(q):
            done = np.flatnonzero(used & (left == 0))
            hit, word = self.whole(lo[done], hi[done])
            found_q.append(q[done[hit]])
            found_w.append(word)
            free = np.flatnonzero(~used)
            state, code = self.preceding(lo[free], hi[free])
            f = free[state]
            fits = np.where(left[f] > 0, codes[starts[q[f]] + np.maximum(left[f] - 1, 0)], -1)
            a, b = self.extend(code, lo[f], hi[f])
            alive = b > a
            f, code, fits, a, b = f[alive], code[alive], fits[alive], a[alive], b[alive]
            other = (code != fits) & (left[f] > 0)
            goes_on = (code == fits) & (b - a > own[q[f]])
            rest = np.flatnonzero(used & (left > 0))
            code = codes[starts[q[rest]] + left[rest] - 1]
            c, d = self.extend(code, lo[rest], hi[rest])
            still = (d > c) & (code > 0)
            # exact so far; one replaced; one more; error spent before
            q, left, used, lo, hi = (
                np.concatenate(x)
                for x in zip(
                    (q[f][goes_on], left[f][goes_on] - 1, np.zeros(goes_on.sum(), bool), a[goes_on], b[goes_on]),
                    (q[f][other], left[f][other] - 1, np.ones(other.sum(), bool), a[other], b[other]),
                    (q[f], left[f], np.ones(len(f), bool), a, b),
                    (q[rest][still], left[rest][still] - 1, np.ones(still.sum(), bool), c[still], d[still]),
                )
            )
        return (np.concatenate(found_q), np.concatenate(found_w)) if found_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def posted(words: DataFrame) -> DataFrame:
    """turned, part, half, word, n: every word under its four halves (``part`` is the length of the shorter word of a pair). Where the first half is to agree, word and half are turned round, so in a task the half always stands at the end."""
    size = F.length("word")

    def entry(turned: bool, length):
        oriented = F.reverse("word") if turned else F.col("word")
        exact = F.floor(length / 2) if turned else length - F.floor(length / 2)
        return F.struct(F.lit(turned).alias("turned"), length.cast("int").alias("part"), F.right(oriented, exact.cast("int")).alias("half"), oriented.alias("word"))

    entries = F.array(*[entry(t, length) for t in (False, True) for length in (size, size - 1)])
    return words.select(F.explode(entries).alias("e"), "n").select("e.*", "n").where("part > 0")


def pairs(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, near, near_n: both directions of every pair of distinct words (word, n) at one edit; a pair that both halves find has two rows."""
    ship(words.sparkSession)
    by = ["turned", "part", "half"]
    rows = posted(words)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dealt = F.ceil(F.col("_n") / group_words).cast("int")
    shared = rows.join(sizes, by).withColumn("shares", dealt)
    # a half that few words share stands as it is; else a word is indexed in one share and asks in all
    asks = F.length("word") == F.col("part")
    own = F.pmod(F.xxhash64("word"), F.col("shares")).cast("int")
    goes = F.when(asks, F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(own))
    shared = shared.withColumn("own", own).withColumn("share", F.explode(goes))
    shared = shared.select(*by, "share", "word", "n", asks.alias("asks"), (F.col("own") == F.col("share")).alias("held"))
    shared = shared.repartition(*by, "share").sortWithinPartitions("turned", "part", "half", "share")

    def search(batches):
        for turned, t in _chunks(batches):
            word, n, asks, held = (t[c].to_pylist() for c in ("word", "n", "asks", "held"))
            index = sorted({w for w, h in zip(word, held) if h})  # a word may stand under several halves
            known = set(index)
            if not index:
                continue
            count = dict(zip(word, n))
            ranks = SuffixRanks(index)
            queries = sorted({w for w, a in zip(word, asks) if a})
            for i in range(0, len(queries), SEARCHED_TOGETHER):
                some = queries[i : i + SEARCHED_TOGETHER]
                exact = np.array([len(w) // 2 if turned else len(w) - len(w) // 2 for w in some], np.int64)
                q, w = ranks.one_error(some, exact, np.array([x in known for x in some], np.int64))
                both = np.unique(q * len(index) + w)
                for j in range(0, len(both), 20_000):
                    a = [some[x] for x in (both[j : j + 20_000] // len(index)).tolist()]
                    b = [index[x] for x in (both[j : j + 20_000] % len(index)).tolist()]
                    na, nb = [count[x] for x in a], [count[x] for x in b]
                    if turned:
                        a, b = [x[::-1] for x in a], [x[::-1] for x in b]
                    yield pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(nb + na, pa.int64())], ["word", "near", "near_n"])

    return shared.mapInArrow(search, "word string, near string, near_n long").where("word <> near")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """(turned, rows) of whole groups, INDEX_WORDS rows or the first group that goes beyond."""
    held, rows = [], 0

    def cut(last: bool):
        t = pa.Table.from_batches(held)
        keys = [t[c].to_numpy() for c in ("turned", "part", "half", "share")]
        new = np.zeros(len(t), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        flip = np.concatenate(([False], keys[0][1:] != keys[0][:-1]))
        edges = np.flatnonzero(new)
        start = 0
        for e in edges:  # chunks end where the direction changes or where enough rows are together
            if flip[e] or e - start >= INDEX_WORDS:
                yield bool(keys[0][start]), t.slice(start, e - start)
                start = int(e)
        rest = t.slice(start)
        if last:
            if len(rest):
                yield bool(keys[0][start]), rest
            held.clear()
        else:
            held[:] = rest.to_batches()

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
            if rows >= 2 * INDEX_WORDS:
                yield from cut(False)
                rows = sum(x.num_rows for x in held)
                rows = rows if rows < 2 * INDEX_WORDS else INDEX_WORDS  # a long group: look again after as many more
    if held:
        yield from cut(True)


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    n_near counts the words at exactly one inserted, deleted or replaced code point; form is the most frequent of them (ties: smallest in code-point order) if it is at least ``ratio`` times as frequent,
    else null; root is where the forms lead (the word itself without a form). Null words, empty words and null counts take no part; further columns are dropped; words that
    repeat count once, with their largest n; words of any length are searched whole; an empty table gives no rows.
    """
    words = words.where("word <> '' AND n IS NOT NULL").groupBy("word").agg(F.max("n").alias("n"))
    words = spool(words, "spelling-words")
    near = pairs(words).groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("all"))  # one row a word that can be made by one edit: bounded by length and alphabet
    near = near.select("word", F.size("all").cast("long").alias("n_near"), F.array_min("all").alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))
    has = F.col("near_n") >= ratio * F.col("n")
    found = spool(found.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    unspool(words)
    # pointers jump: each form is ``ratio`` times as frequent as the one before, so few rounds reach every root
    roots = spool(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = spool(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        unspool(roots)
        roots = step
        if step.where("moved").isEmpty():
            break
    return found.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: crc32 bit by bit over bytes, as SQL has no function for it.
_TABLE = "SELECT list(list_reduce(list_prepend(CAST(i AS UBIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"
CRC32 = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode({x}))), lambda i: CAST(('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2)) AS UBIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT)"
OP11_SQL = f"""
WITH crc AS ({_TABLE}),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{7,}}')) AS run FROM documents)),
once AS (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS x FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {CRC32.format(x='x')} AS h FROM once, crc),
made AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.less = b.word),
g AS (SELECT word, count(*) AS n_near, min({{'n': -near_n, 'near': near}}) AS best FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 10 * w.n THEN best.near END AS form, CASE WHEN -best.n >= 10 * w.n THEN -best.n END AS form_n
  FROM w LEFT JOIN g USING (word)),
r AS (
  WITH RECURSIVE s AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON s.next = f.word)
  SELECT word, root FROM s WHERE next IS NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN r USING (word)
"""
