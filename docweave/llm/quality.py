"""Quality classifier: histogram gradient-boosted trees over statistics of a document, flattened into arrays.

Trees are grown level by level on binned statistics (histograms of gradients, quantile bins), on the driver, from at most FIT_ROWS labelled
rows. Fitted, all trees lie in three arrays (statistic, threshold, leaf value), and a batch of documents goes down all trees at once, level by
level, with numpy. All texts are scored whole. Neither labels, lang, source nor doc_id are inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_text, held_out, lean, ship, table

FOLDS, FOLD = 5, 0
THRESHOLD = 0.3
#: Most labelled rows that trees are fitted on: those with the smallest hash of doc_id.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15

STATISTICS = (
    "log_bytes log_words mean_word longest_word distinct_words distinct_pairs repeated_next top_word top_pair log_lines words_a_line distinct_lines "
    "letters digits capitals blanks sentence_marks symbols bars marks_a_word beyond_ascii byte_entropy word_entropy short_words ends_in_symbol sentence_length"
).split()

_CLASS = np.zeros((256, 8))
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (
        _c < 128 and _ch.isalpha(),
        48 <= _c <= 57,
        65 <= _c <= 90,
        _c in b" \t\r\n\v\f",
        _c in b".,;:!?",
        _c < 128 and not _ch.isalnum() and _c not in b" \t\r\n\v\f.,;:!?'\"()-",
        _c == 124,
        _c >= 128,
    )


def statistics(text: str | None) -> list[float]:
    """The numbers a text is judged by; an empty or null text has 0 for all."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [math.log1p(len(raw))] + [0.0] * (len(STATISTICS) - 1)
    n, size = len(words), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, digits, capitals, blanks, marks, symbols, bars, beyond = (counts @ _CLASS).tolist()
    share = counts[counts > 0] / size
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = Counter(zip(words, words[1:])) if n > 1 else Counter()
    freq = np.fromiter(seen.values(), float, len(seen)) / n
    ends = sum(w[-1:] in b"%$#&*@~^=+<>|" for w in seen)
    return [
        math.log1p(size), math.log1p(n), float(lengths.mean()), math.log1p(int(lengths.max())),
        len(seen) / n, len(pairs) / max(1, n - 1), sum(map(eq, words, words[1:])) / max(1, n - 1), max(seen.values()) / n,
        max(pairs.values(), default=0) / max(1, n - 1), math.log1p(len(lines)), n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
        letters / size, digits / size, capitals / size, blanks / size, marks / size, symbols / size, bars / size, (marks + symbols) / n, beyond / size,
        float(-(share * np.log(share)).sum()), float(-(freq * np.log(freq)).sum() / max(1.0, math.log(n))) if n > 1 else 0.0,
        float((lengths <= 3).mean()), ends / len(seen), n / (1 + counts[46] + counts[33] + counts[63]),
    ]


class Trees:
    """Boosted trees of equal depth. Node k of a tree has the children 2k + 1 and 2k + 2; a row goes right where its statistic exceeds the threshold."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        out = np.full(len(x), self.base)
        if len(self.leaf):
            tree = np.arange(len(self.leaf))[None, :]
            depth = int(math.log2(self.leaf.shape[1]))
            for i in range(0, len(x), 4096):
                rows = np.arange(len(x[i : i + 4096]))[:, None]
                node = np.zeros((len(rows), tree.shape[1]), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (x[i + rows, self.feature[tree, node]] > self.threshold[tree, node])
                out[i : i + 4096] += self.leaf[tree, node - (self.leaf.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: float = 5.0, l2: float = 2.0) -> Trees:
    """Fit to labels 0 and 1. With one class only, or no rows, there are no trees and the score is the (smoothed) share of 1."""
    n, m = x.shape
    base = math.log((y.sum() + 1) / (n - y.sum() + 1))
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, (1 << depth) - 1), int), np.zeros((0, (1 << depth) - 1)), np.zeros((0, 1 << depth)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    raw = np.full(n, base)
    inner = (1 << depth) - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            here = node - first
            best = np.zeros(width)
            at = [None] * width
            for j in range(m):
                k = len(cuts[j]) + 1
                if k == 1:
                    continue
                key = here * k + binned[:, j]
                gs = np.bincount(key, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(key, h, width * k).reshape(width, k).cumsum(1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < least / 4) | (ha - hl < least / 4)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                for w in np.flatnonzero(value > best + 1e-9):
                    best[w], at[w] = value[w], (j, top[w])
            for w in range(width):
                if at[w] is not None:
                    feature[first + w], threshold[first + w] = at[w][0], cuts[at[w][0]][at[w][1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf_of = node - inner
        leaf = -rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + l2)
        raw += leaf[leaf_of]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Trees from at most ``fit_rows`` labelled rows that are not held out; a doc_id with several labels has the smallest of them."""
    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)

    def run(batches):
        for b in batches:
            x = [statistics(t) for t in each_text(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    few = docs.select(docs["doc_id"].alias("_doc"), docs["text"].alias("_text"))  # other columns of docs may have any name
    few = few.join(F.broadcast(some), F.col("_doc") == F.col("_id"))
    few = few.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.first("label").alias("label"))  # a doc_id may repeat; fit_rows stays the bound
    rows = few.select("_text", "label").mapInArrow(lean(run), "x array<double>, label int").collect()
    rows.sort(key=lambda r: (r["x"], r["label"]))  # as partitions may come in any order
    return grow(np.array([r["x"] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r["label"] for r in rows], float))


def _scores(texts: pa.Array, trees: Trees) -> np.ndarray:
    return trees.predict(np.array([statistics(t) for t in each_text(texts)]).reshape(-1, len(STATISTICS)))


def score(docs: DataFrame, trees: Trees, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """doc_id, score of every row. Null text scores like the empty text; a null id stays null. Rows are independent of each other: equal texts (ties, repeated rows, rows of one id) score alike and stand each, in no stated order; texts of any length are read whole; further columns, whatever their names, are neither read nor returned; an empty table gives no rows."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), trees))], ["doc_id", "score"])

    return docs.select(docs[id_].alias("doc_id"), docs[text].alias("text")).mapInArrow(lean(run), f"doc_id {docs.schema[id_].dataType.simpleString()}, score double")


def is_good(score_: Column) -> Column:
    return (score_ >= THRESHOLD).cast("int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at least THRESHOLD, with the columns of ``docs``. Only texts go to Python and only scores come back; null texts are judged as empty ones."""
    trees = fit(docs, labels)

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(_scores(texts, trees))

    return docs.where(quality(docs["text"]) >= THRESHOLD)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", is_good(F.col("score")).alias("predicted"))
