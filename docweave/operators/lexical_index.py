"""An inverted index in blocks with maximum impacts, and ranking that leaves out what can't be among the best."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import cut, drop

#: Documents of a block. A token's row for a block holds the block's postings, the best first, and their highest impact.
BLOCK_DOCUMENTS = 128
#: A query first looks at its rarest tokens, until they have this many postings for each result wanted.
SEEDS = 2
#: Up to so many tokens are looked for by a filter in the tasks that read texts.
ASKED = 10_000
#: Sums of shares are compared with this much room, as they are added in another order.
ROOM = 1e-9


@dataclass
class Index:
    """documents: path, in_content and in_path (distinct tokens); postings: token, block, best, n, list of (impact, path); tokens: token, df, best. Written tables: what is read from them is pruned by column and token."""

    documents: DataFrame
    postings: DataFrame
    tokens: DataFrame

    def drop(self) -> None:
        """Delete the tables, when nothing reads them any more."""
        drop(self.documents, self.postings, self.tokens)


def asked_tokens(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """path, in_content, in_path (distinct tokens) of documents (path, content); of ``only`` (token), if given, no others. Up to ASKED tokens stand in a filter where a text is read; more meet the texts' tokens in a join. A written table."""
    documents = docs.select("path", T.tokens(F.col("content")).alias("in_content"), T.tokens(F.col("path")).alias("in_path"))
    if only is None:
        return cut(documents)
    wanted = cut(only.select("token").distinct())  # its size is known now
    few = [r["token"] for r in wanted.limit(ASKED + 1).collect()]
    if len(few) <= ASKED:
        asked = lambda c: F.array_distinct(F.filter(T.token_list(F.col(c)), lambda t: t.isin(few)))
        out = cut(docs.select("path", asked("content").alias("in_content"), asked("path").alias("in_path")))
    else:
        weighed = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))
        each = documents.select("path", F.explode(F.concat(weighed("in_content", 1.0), weighed("in_path", 0.5))).alias("t")).select("path", "t.*")
        kept = each.join(wanted, "token", "left_semi").repartition("path")
        out = cut(kept.groupBy("path").agg(F.collect_list(F.when(F.col("w") == 1.0, F.col("token"))).alias("in_content"), F.collect_list(F.when(F.col("w") == 0.5, F.col("token"))).alias("in_path")))
    drop(wanted)
    return out


def build_index(docs: DataFrame, only: DataFrame | None = None, also: DataFrame | None = None) -> Index:
    """Of documents (path, content; one row a path). An impact is 1 for a token of the content and half for one of the path. ``only`` (token) keeps what some queries can ask for, of documents too; of documents ``also`` (token) is kept besides, for phrases to
    look up. Null contents have no tokens; null paths are no documents.

    Texts leave the task that reads them as tokens; a document goes to its block in one row, and the block's postings are made where it lies.
    """
    kept = only if also is None or only is None else only.select("token").unionByName(also.select("token"))
    documents = asked_tokens(docs.where("path IS NOT NULL"), kept)
    blocks = max(1, -(-documents.count() // BLOCK_DOCUMENTS))
    placed = documents.withColumn("block", F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int")).repartition("block")
    impact = lambda t: F.struct(t.alias("token"), F.when(F.array_contains("in_path", t), 1.5).otherwise(1.0).alias("impact"))
    path_only = F.transform(F.array_except("in_path", "in_content"), lambda t: F.struct(t.alias("token"), F.lit(0.5).alias("impact")))
    held = placed.select("block", "path", F.explode(F.concat(F.transform("in_content", impact), path_only)).alias("t")).select("block", "path", "t.*")
    if only is not kept:
        held = held.join(only.select("token").distinct(), "token", "left_semi")
    listed = F.sort_array(F.collect_list(F.struct("impact", "path")), asc=False)  # a block's documents at most
    postings = cut(held.groupBy("block", "token").agg(F.max("impact").alias("best"), F.count(F.lit(1)).alias("n"), listed.alias("list")))
    tokens = cut(postings.groupBy("token").agg(F.sum("n").alias("df"), F.max("best").alias("best")))
    return Index(documents, postings, tokens)


def _shares(pairs: DataFrame, questions: DataFrame, index: Index) -> DataFrame:
    """query_id, path, share of (query_id, path): the share of the query's tokens in the content and half the share in the path."""
    n = F.greatest(F.size("tokens"), F.lit(1))
    # a document that holds none of the tokens may still hold a phrase, inside a longer word
    both = pairs.where("path IS NOT NULL").join(questions.select("query_id", "tokens"), "query_id").join(index.documents, "path", "left")
    common = lambda c: F.coalesce(F.size(F.array_intersect("tokens", F.coalesce(c, F.array().cast("array<string>")))), F.lit(0))
    return both.select("query_id", "path", (common("in_content") / n + common("in_path") / n * 0.5).alias("share"))


def best_hits(questions: DataFrame, index: Index, phrases: DataFrame, k: int, counts: dict | None = None) -> DataFrame:
    """query_id, path, score: at least the k best documents of each query (query_id, tokens), ties by path among them; score is the share plus half for the hits of ``phrases`` (query_id, path).

    1. The postings of a query's rarest tokens are expanded; their documents and those with the phrase have exact scores, and the kth is a threshold.
    2. Common tokens whose highest impacts together stay below the threshold are never looked at: a document with these alone can't reach it. Of the other tokens only those blocks are expanded
       whose maxima, with all that the common ones could add, reach the threshold; and only documents whose own sum does are scored.
    Every document that ties with the kth is among the expanded ones. ``counts``, if given, gets the postings expanded and those that a full join would have met.
    """
    size = F.greatest(F.size("tokens"), F.lit(1))
    words = questions.select("query_id", size.alias("size"), F.explode("tokens").alias("token")).join(index.tokens, "token")
    rare = Window.partitionBy("query_id").orderBy("df", "token")
    before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = cut(words.withColumn("seed", before < SEEDS * k))
    met = words.where("seed").join(index.postings.select("token", "block", "n", "list"), "token")
    seeds = met.select("query_id", F.explode("list.path").alias("path")).unionByName(phrases.select("query_id", "path")).distinct()
    bonus = phrases.select("query_id", "path", F.lit(0.5).alias("bonus")).distinct()

    def scored(pairs: DataFrame) -> DataFrame:
        return _shares(pairs, questions, index).join(bonus, ["query_id", "path"], "left").select("query_id", "path", (F.col("share") + F.coalesce("bonus", F.lit(0.0))).alias("score"))

    first = cut(scored(seeds))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    bar = first.withColumn("_n", nth).where(F.col("_n") == k).select("query_id", F.col("score").alias("bar"))
    # the most common tokens first: as long as their highest impacts together stay below the bar they are left out
    common = Window.partitionBy("query_id").orderBy(F.col("df").desc(), F.col("token").desc())
    most = F.sum(F.col("best") / F.col("size")).over(common)
    parted = words.join(bar, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    parted = parted.withColumns({"left_out": most < F.col("bar") - ROOM, "most": most})
    parted = cut(parted.withColumn("others", F.coalesce(F.max(F.when(F.col("left_out"), F.col("most"))).over(Window.partitionBy("query_id")), F.lit(0.0))))
    asked = parted.where("NOT left_out").select("query_id", "token", "size", "bar", "others")
    blocks = asked.join(index.postings.select("token", "block", F.col("best").alias("block_best"), "n"), "token")
    reach = blocks.groupBy("query_id", "block").agg((F.sum(F.col("block_best") / F.col("size")) + F.first("others")).alias("reach"), F.first("bar").alias("bar"))
    reach = reach.where(F.col("reach") >= F.col("bar") - ROOM).select("query_id", "block")
    alive = blocks.join(reach, ["query_id", "block"], "left_semi").select("query_id", "token", "block", "n", "size", "bar", "others")
    # the sum over the tokens that were expanded, and what the others can add at most, rule most documents out before they are scored
    more = alive.join(index.postings.select("token", "block", "list"), ["token", "block"]).select("query_id", "size", "bar", "others", F.explode("list").alias("p"))
    most = F.sum("p.impact") / F.first("size") + F.first("others")
    more = more.groupBy("query_id", F.col("p.path").alias("path")).agg(most.alias("most"), F.first("bar").alias("bar")).where(F.col("most") >= F.col("bar") - ROOM).select("query_id", "path")
    second = cut(scored(more.join(first.select("query_id", "path"), ["query_id", "path"], "left_anti")))
    if counts is not None:
        counts["expanded"] = (met.agg(F.sum("n")).first()[0] or 0) + (alive.agg(F.sum("n")).first()[0] or 0)
        counts["all"] = words.agg(F.sum("df")).first()[0] or 0
    out = cut(first.unionByName(second).where("score > 0"))
    drop(words, first, parted, second)
    return out


def trigram_hits(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, path of the texts (path, text) that hold the phrase (query_id, phrase).

    Only texts that have all trigrams of a phrase are tested: its rarest trigram proposes texts, which its other trigrams confirm. Phrases of fewer than three characters have no trigram; these alone are tested on every text.
    """
    at = F.sequence(F.lit(1), F.length("phrase") - 2)
    grams = phrases.where(F.length("phrase") >= 3).select("query_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("phrase", i, F.lit(3))))).alias("gram"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                found = list({text[i : i + 3] for i in range(len(text) - 2)})
                for i in range(0, len(found), 50_000):
                    part = found[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(part, pa.string())], ["path", "gram"])

    postings = docs.select("path", "text").mapInArrow(cut_up, "path string, gram string").join(grams.select("gram").distinct(), "gram", "left_semi")
    postings = cut(postings)
    df = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # a trigram that no text has rules the phrase out, and so does the join on it
    rarest = grams.join(df, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"), F.count(F.lit(1)).alias("grams"))
    proposed = rarest.join(postings, "gram").select("query_id", "path", "grams")
    confirmed = proposed.join(grams, "query_id").join(postings, ["path", "gram"]).groupBy("query_id", "path").agg((F.count(F.lit(1)) == F.first("grams")).alias("whole")).where("whole")
    texts = docs.select("path", "text")
    found = confirmed.join(phrases.select("query_id", "phrase"), "query_id").join(texts, "path").where(F.contains("text", F.col("phrase"))).select("query_id", "path")
    short = phrases.where((F.length("phrase") < 3) & (F.length("phrase") > 0)).select("query_id", "phrase")
    return found.unionByName(texts.join(short, F.contains("text", F.col("phrase"))).select("query_id", "path"))
