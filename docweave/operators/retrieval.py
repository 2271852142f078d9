"""Lexical, semantic and hybrid retrieval, and everything around a hit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..functions import urls as U
from .graph import cut, drop
from .lexical_index import Index, asked_tokens, best_hits, build_index, trigram_hits
from .vector_store import Store, build_store, nearest


def phrase_hits(phrases: DataFrame, docs: DataFrame, fold: bool = True, index: Index | None = None) -> DataFrame:
    """query_id, path of the documents (path, content) that hold the whole phrase of (query_id, phrase); both case-folded, unless ``fold`` is false.

    The first and last token of a phrase may go on in a longer word, those between stand as they are in any text that holds it. So a document must have all tokens between: an inverted join on the rarest of
    them, then a look at the others, then the test on the texts of what is left, which are joined as they stand and folded after that. Phrases of fewer than three tokens have none between; they are found through
    their trigrams. The documents' ``index`` spares reading tokens out of texts. The result is a written table.
    """
    p = phrases.where("phrase <> ''").select("query_id", (T.casefold(F.col("phrase")) if fold else F.col("phrase")).alias("phrase"), T.token_list(F.col("phrase")).alias("_ts"))
    p = cut(p.withColumn("between", F.when(F.size("_ts") > 2, F.array_distinct(F.slice("_ts", F.lit(2), F.size("_ts") - 2)))).drop("_ts"))
    between = p.select("query_id", F.explode("between").alias("token"))
    documents = index.documents if index else asked_tokens(docs, between)  # read twice; texts are cut into tokens once
    postings = documents.select("path", F.explode("in_content").alias("token")).join(between.select("token").distinct(), "token", "left_semi")
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # a token that no document has rules the phrase out, and so does any join on it
    rarest = cut(between.join(df, "token", "left").groupBy("query_id").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token")))
    pairs = postings.join(rarest, "token").select("query_id", "path")
    whole = F.size(F.array_except("between", "in_content")) == 0
    # its size is known now, so texts need not be shuffled to meet a few pairs
    pairs = cut(pairs.join(p.select("query_id", "between"), "query_id").join(documents.select("path", "in_content"), "path").where(whole).select("query_id", "path"))
    text = lambda c: T.casefold_safe(F.col(c)) if fold else F.col(c)
    found = docs.select("path", "content").join(pairs, "path").join(p.select("query_id", "phrase"), "query_id").where(F.contains(text("content"), F.col("phrase"))).select("query_id", "path")
    short = p.where("between IS NULL").select("query_id", "phrase")
    if not short.isEmpty():
        found = found.unionByName(trigram_hits(short, docs.select("path", text("content").alias("text"))))
    out = cut(found)
    drop(p, rarest, pairs, *([] if index else [documents]))
    return out


def rank_documents(queries: DataFrame, docs: DataFrame, k: int = 5, index: Index | None = None, counts: dict | None = None) -> DataFrame:
    """query_id, path, score, rank: the k best documents (path, content) of each query (query_id, query).

    score = share of the query's tokens in the content + half the share in the path + 0.5 if the whole query occurs in the content, all case-folded. Documents without any hit
    score 0 and fill short lists; ties go by path. The documents' ``index`` (build_index) may be given; else one of the queries' tokens is built. What can't be among the k best is not expanded (see best_hits).
    """
    q = cut(queries.select("query_id", F.coalesce("query", F.lit("")).alias("phrase"), T.tokens(F.col("query")).alias("tokens")))
    own = index or build_index(docs, q.select(F.explode("tokens").alias("token")))
    phrases = phrase_hits(q, docs, index=own)
    hits = best_hits(q, own, phrases, k, counts)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path")
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # fill: of the first 2k paths at most k are hits already, so k others are always left; a hit among them has a better score and stands with that
    first = docs.select("path").distinct().orderBy("path").limit(2 * k)
    fill = q.select("query_id").join(F.broadcast(first), F.lit(True)).select("query_id", "path", F.lit(0.0).alias("score"))
    all_ = top.drop("rank").unionByName(fill).groupBy("query_id", "path").agg(F.max("score").alias("score"))
    out = cut(all_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    drop(q, phrases, hits)
    if index is None:
        own.drop()
    return out


def citations(hits: DataFrame) -> DataFrame:
    """source, citations (distinct, in order) from (source, locators array of struct<kind, label>)."""
    all_ = F.array_compact(F.transform("locators", lambda x: R.citation(F.col("source"), x["kind"], x["label"])))
    return hits.withColumn("citations", F.array_distinct(F.coalesce(all_, F.array().cast("array<string>"))))


def hit_metadata(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits (query_id, path, ...) with title, format, quality_status, locators and citations of their source (destination). Hits without source keep nulls and no citations."""
    s = sources.withColumn("path", F.regexp_replace(F.replace("destination", F.lit("\\"), F.lit("/")), r"^[./]+", "")).select("path", "title", "format", "quality_status", "locators")
    joined = hits.join(s, "path", "left").withColumn("source", F.col("path"))
    return citations(joined).drop("source")


def get_document(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """request_id, path, status (found, not_found, unsafe_path), content, score of exact paths."""
    r = requests.withColumn("safe", U.safe_relpath(F.col("path")))
    d = docs.select(F.col("path").alias("_path"), "content")
    both = r.join(d, r["safe"] == d["_path"], "left")
    status = F.when(F.col("safe").isNull(), "unsafe_path").when(F.col("_path").isNull(), "not_found").otherwise("found")
    return both.select("request_id", "path", status.alias("status"), "content", F.when(status == "found", 1.0).alias("score"))


def expand_query(queries: DataFrame, synonyms: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """query_id, tokens: the query's tokens and what they expand to, sorted. synonyms (term, expansion) work in one direction, groups (group_id, term) between all their terms: a query meets a group once, by its id, whatever the group's size. Which side of a join goes to all tasks is left to the optimiser's size check."""
    t = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term"))
    more = t.join(synonyms.select("term", "expansion"), "term").select("query_id", F.col("expansion").alias("term"))
    if groups is not None:
        g = groups.select("group_id", "term").distinct()
        met = t.join(g, "term").select("query_id", "group_id").distinct()
        more = more.unionByName(met.join(g, "group_id").select("query_id", "term"))
    return t.unionByName(more).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("tokens"))


def categorize(docs: DataFrame, mappings: DataFrame) -> DataFrame:
    """path, category: the category of the longest pattern (pattern, category) that the path contains (ties: smallest category); null without any. Distinct paths meet the patterns in a join by containment, so the mapping is meant to be a short table."""
    hit = docs.select("path").distinct().join(mappings.select("pattern", "category").distinct(), F.contains(F.lower("path"), F.lower("pattern")), "left")
    best = F.min(F.struct((-F.length("pattern")).alias("l"), "category"))["category"]
    return hit.groupBy("path").agg(best.alias("category"))


def keyword_routes(queries: DataFrame, routes: DataFrame) -> DataFrame:
    """query_id, categories (sorted) whose keyword (keyword, category) the query contains: a preference, not a filter. The routes are meant to be a short table, as queries meet them in a join by containment."""
    q = queries.select("query_id", T.casefold_safe(F.col("query")).alias("folded"))
    hit = q.join(routes.select("keyword", "category"), F.contains("folded", T.casefold(F.col("keyword"))), "left")
    return hit.groupBy("query_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))


#: Queries that name an identifier: a vulnerability number, a hash, dotted or underscored names, calls, camel case.
IDENTIFIER = r"(?i:cve-\d{4}-\d{4,})|\b[0-9a-fA-F]{32,64}\b|\b[A-Za-z_]\w*(?:[._][A-Za-z_]\w*)+\b|\b\w+\(\)|\b[a-z]+[A-Z]\w*\b"


def lexical_fast_path(queries: DataFrame, hits: DataFrame, min_hits: int = 3) -> DataFrame:
    """query_id, mode: lexical where the query looks like an identifier and has at least ``min_hits`` lexical hits above 0, else hybrid."""
    n = hits.where("score > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    q = queries.select("query_id", F.coalesce("query", F.lit("")).rlike(IDENTIFIER).alias("identifier")).join(n, "query_id", "left")
    return q.select("query_id", F.when(F.col("identifier") & (F.coalesce("n", F.lit(0)) >= min_hits), "lexical").otherwise("hybrid").alias("mode"))


#: bm25 scores one chunk in so many first; the kth best of a query among these is a bar that its best k of all reach.
SLICES = 64
#: Rows (chunk, token) that a task scores: a few times as many (query, chunk) sums must fit its memory.
SCORED_ROWS = 500_000


def bm25(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best chunks (chunk_id, text; one row a chunk). Document frequencies count all chunks.

    Texts are read and cut into tokens once: what is written of a chunk is its length and how often it holds the tokens that are asked for. A chunk's rows are scored in one task, and only scores that reach a
    query's bar are sorted and sent on.
    """
    words = cut(queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("token")))
    listed = chunks.select("chunk_id", T.token_list(F.col("text")).alias("ts"))
    asked = words.select("token", F.col("token").alias("asked")).distinct()
    t = listed.select("chunk_id", F.size("ts").alias("len"), "ts").select("chunk_id", "len", F.posexplode_outer("ts").alias("at", "token")).join(asked, "token", "left")
    # each chunk keeps one row at least, for the number of chunks and their mean length
    t = t.where("asked IS NOT NULL OR coalesce(at, 0) = 0")
    tf = cut(t.groupBy("chunk_id", "len", F.col("asked").alias("token")).agg(F.count(F.lit(1)).alias("tf"), F.max(F.coalesce("at", F.lit(0)) == 0).alias("first")))
    stats = tf.where("first").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    df = tf.where("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = cut(words.join(df, "token").crossJoin(F.broadcast(stats)).select("query_id", "token", idf.alias("idf"), "mean"))  # one row of stats
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))

    parts = max(1, -(-tf.count() // SCORED_ROWS))

    def scored(rows: DataFrame, parts: int) -> DataFrame:
        return rows.repartition(parts, "chunk_id").join(weights, "token").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))

    held = tf.where("token IS NOT NULL").select("chunk_id", "len", "token", "tf")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    best = lambda s: s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    bar = cut(best(scored(held.where(F.pmod(F.xxhash64("chunk_id"), F.lit(SLICES)) == 0), -(-parts // SLICES))).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar")))
    out = cut(best(scored(held, parts).join(bar, "query_id", "left").where("bar IS NULL OR score >= bar").drop("bar")))
    drop(words, tf, weights, bar)
    return out


def cosine(query_vectors: DataFrame, vectors: DataFrame, k: int, store: Store | None = None, counts: dict | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k nearest (chunk_id, embedding) by cosine of each query vector (query_id, embedding): scores rounded to 9 places, ties to the smaller chunk_id. Exact.

    A ``store`` of the vectors (build_store) may be given, else one is built. Parts that can't hold one of the k nearest are skipped, and a task sends k rows a query at most.
    """
    held = store or build_store(vectors)
    out = nearest(held, query_vectors, k, counts) if held else None
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    return out


def fuse(lexical: DataFrame, semantic: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank: reciprocal-rank fusion of two ranked lists."""
    both = lexical.select("query_id", "chunk_id", F.col("rank").alias("a")).join(semantic.select("query_id", "chunk_id", F.col("rank").alias("b")), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (constant + F.col(c)), F.lit(0.0))
    s = both.select("query_id", "chunk_id", F.round(part("a") + part("b"), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_search(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5, pool: int = 50) -> DataFrame:
    """query_id, document, chunk_id, score, rank: BM25 and cosine candidates (min(3k, pool) each) fused by rank; each document stands with its best chunk."""
    n = min(3 * k, pool)
    fused = cut(fuse(bm25(queries, chunks, n), cosine(query_vectors, vectors, n), 2 * n))  # its size is known now: 2n rows a query
    with_doc = fused.drop("rank").join(chunks.select("chunk_id", "document"), "chunk_id")
    best = Window.partitionBy("query_id", "document").orderBy(F.col("score").desc(), "chunk_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "document")
    one = with_doc.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "document", "chunk_id", "score", "rank")


def hybrid_retriever(query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, pool: int = 50) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """hybrid_search as a retriever for the registry: the chunks of the documents asked about, with vectors of queries and chunks that some model gave before."""

    def run(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
        own = chunks.join(docs.select(F.col("path").alias("document")), "document", "left_semi")
        return hybrid_search(queries, query_vectors, own, vectors, k, pool).select("query_id", F.col("document").alias("path"), "score", "rank")

    return run


#: Retrievers by name: (queries, docs, k) -> hits (query_id, path, score, rank). Users add their own.
RETRIEVERS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {"lexical": rank_documents, "memory": rank_documents}


def register_retriever(name: str, search: Callable[[DataFrame, DataFrame, int], DataFrame]) -> None:
    RETRIEVERS[name] = search


def search(name: str, queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """Hits of a registered retriever, with its name."""
    return RETRIEVERS[name](queries, docs, k).withColumn("retriever", F.lit(name))
