"""Block-max ranking, trigram phrases and the vector store against plain forms, with what they leave out counted."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import lexical_index, retrieval, vector_store


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(5)
    rare = [f"term{i}" for i in range(300)]
    docs = [(f"d/{i:04d}.md", " ".join(["the", "and", "of"] * (i % 3) + rng.sample(rare, 6) + (["common"] if i % 2 else []))) for i in range(900)]
    docs += [("d/null.md", None), ("d/empty.md", ""), ("d/the.md", "the and of"), ("d/two.md", "a b")]
    queries = [(i, " ".join([*rng.sample(rare, 2), "the", "and", "of", "common"])) for i in range(12)]
    queries += [(20, "the and"), (21, docs[5][1]), (22, ""), (23, None), (24, "unheard"), (25, "b"), (26, "term17"), (27, "The AND of")]
    return spark.createDataFrame(docs, "path string, content string"), spark.createDataFrame(queries, "query_id long, query string"), docs, queries


def plain(docs, queries, k):
    import re

    fold = lambda x: (x or "").lower().replace("ß", "ss")
    tokens = lambda x: list(dict.fromkeys(re.findall(r"[\w][\w./:-]*", fold(x))))
    out = {}
    for q, text in queries:
        want, phrase, scored = tokens(text), fold(text), []
        for path, content in docs:
            n = max(len(want), 1)
            score = len(set(want) & set(tokens(content))) / n + len(set(want) & set(tokens(path))) / n * 0.5 + (0.5 if phrase and phrase in fold(content) else 0)
            scored.append((-round(score, 9), path))
        out[q] = [(p, -s) for s, p in sorted(scored)[:k]]
    return out


def test_ranking_equals_the_plain_form_and_leaves_postings_out(spark, library):
    docs, queries, d, q = library
    counts = {}
    got = {}
    for r in retrieval.rank_documents(queries, docs, 5, counts=counts).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["path"], round(r["score"], 9)))
    assert got == plain(d, q, 5)
    assert counts["expanded"] < 0.5 * counts["all"]
    index = retrieval.build_index(docs)  # of all tokens, for any queries
    again = retrieval.rank_documents(queries, docs, 5, index=index)
    assert {(r["query_id"], r["path"], r["rank"]) for r in again.collect()} == {(q_, p, i + 1) for q_, hits in got.items() for i, (p, _) in enumerate(hits)}
    index.drop()
    assert retrieval.rank_documents(queries.limit(0), docs).count() == 0 and retrieval.rank_documents(queries, docs.limit(0)).count() == 0


def test_index_of_asked_tokens_holds_no_others(spark, library):
    docs, _, _, _ = library
    only = spark.createDataFrame([("term17",), ("common",), ("d/0003.md",)], "token string")
    index = lexical_index.build_index(docs, only)
    held = index.documents.select(F.explode(F.concat("in_content", "in_path")).alias("token")).distinct().collect()
    assert {r["token"] for r in held} == {"term17", "common", "d/0003.md"}
    index.drop()
    # a phrase inside a longer word, in a document without any token of the query
    inside = spark.createDataFrame([("p/1", "xxabcxx"), ("p/2", "other"), (None, "abc")], "path string, content string")
    got = retrieval.rank_documents(spark.createDataFrame([(1, "abc"), (2, "ab")], "query_id long, query string"), inside, 1).collect()
    assert {(r["query_id"], r["path"], r["score"]) for r in got} == {(1, "p/1", 0.5), (2, "p/1", 0.5)}


@pytest.mark.parametrize("rows", [500_000, 300])
def test_bm25_reads_each_text_once(spark, rows, monkeypatch):
    import math
    import re

    monkeypatch.setattr(retrieval, "SCORED_ROWS", rows)  # one task, several tasks
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(1, 30)))) for i in range(700)] + [(700, None), (701, ""), (702, "zz zz"), (703, "...")]
    queries = [(1, "w3 w39 W38"), (2, "zz"), (3, "unheard"), (4, None), (5, "w39 w39 w0 zz")]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    chunks = spark.createDataFrame(texts, "chunk_id long, text string").mapInArrow(count, "chunk_id long, text string")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.bm25(spark.createDataFrame(queries, "query_id long, query string"), chunks, 6).collect()}
    assert read.value == len(texts)
    cut = {i: re.findall(r"\w[\w./:-]*", t or "") for i, t in texts}
    mean, want = sum(map(len, cut.values())) / len(cut), {}
    for q, query in queries:
        scores = {}
        for token in dict.fromkeys((query or "").lower().split()):
            df = sum(token in ts for ts in cut.values())
            for i, ts in cut.items():
                if n := ts.count(token):
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(cut) - df + 0.5) / (df + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(ts) / mean))
        for rank, (i, x) in enumerate(sorted(scores.items(), key=lambda p: (-round(p[1], 9), p[0]))[:6]):
            want[q, rank + 1] = (i, x)
    assert got.keys() == want.keys()
    for k, (i, x) in want.items():
        assert got[k] == (i, pytest.approx(x, abs=2e-9))


def test_impacts_stand_first_in_blocks(spark):
    docs = spark.createDataFrame([(f"{'x' if i % 7 else 'word'}/{i}.md", "word other" if i % 3 else "word") for i in range(400)], "path string, content string")
    index = lexical_index.build_index(docs)
    rows = index.postings.where("token = 'word'").collect()
    assert len(rows) > 1 and sum(r["n"] for r in rows) == 400
    for r in rows:
        impacts = [x["impact"] for x in r["list"]]
        assert impacts == sorted(impacts, reverse=True) and r["best"] == impacts[0] and r["n"] == len(impacts)
    index.drop()


def test_trigrams_find_all_phrases(spark):
    texts = [("a", "hello world"), ("b", "xxhello"), ("c", "helloo wor"), ("d", None), ("e", ""), ("f", "héllo ✓ ok"), ("g", "ab"), ("h", "hel llo elo")]
    phrases = [(1, "hello"), (2, "lo w"), (3, "ab"), (4, "✓ o"), (5, "zzz"), (6, "hello world and more"), (7, ""), (8, "o")]
    got = {(r["query_id"], r["path"]) for r in lexical_index.trigram_hits(spark.createDataFrame(phrases, "query_id long, phrase string"), spark.createDataFrame(texts, "path string, text string")).collect()}
    assert got == {(q, p) for q, x in phrases for p, t in texts if x and t and x in t}


def clusters(seed, n, groups, d=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    return centre[rng.integers(0, groups, n)] * rng.uniform(1, 5, (n, 1)) + rng.normal(size=(n, d)) * 0.05


def brute(q, x, ids, k):
    u = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    s = np.round(u(q) @ u(x).T, 9)
    return [[(int(ids[j]), s[i, j]) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(q))]


@pytest.mark.parametrize("part_rows", [10_000, 40])
def test_vector_store_is_exact_and_skips_parts(spark, part_rows, monkeypatch):
    monkeypatch.setattr(vector_store, "QUERIES", 7)  # several slices
    x = clusters(1, 1200, 12)
    x[100:400] = x[100]  # copies: ties go to the smaller id
    ids = np.random.default_rng(2).permutation(1200) * 3
    q = x[::60]
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + [(-1, None)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    store, counts = vector_store.build_store(vectors, part_rows), {}
    got = {}
    for r in retrieval.cosine(queries, vectors, 9, store, counts).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    want = brute(q, x, ids, 9)
    for i, rows in enumerate(want):
        assert [a for a, _ in got[i]] == [a for a, _ in rows] and [s for _, s in got[i]] == pytest.approx([s for _, s in rows])
    assert counts["searched"] == counts["all"] if part_rows == 10_000 else counts["searched"] < 0.5 * counts["all"]
    one_task = store.vectors.coalesce(1)
    sent = vector_store._search(vector_store.Store(one_task, store.path, store.centres, store.radii, store.sizes), np.arange(len(q)), q / np.linalg.norm(q, axis=1, keepdims=True), np.ones((len(q), len(store.centres)), bool), 9)
    assert sent.count() == 9 * len(q)  # k rows a query and task, whatever the task reads
    store.delete()
    assert retrieval.cosine(queries, vectors.limit(0), 3).count() == 0 and retrieval.cosine(queries.limit(0), vectors, 3).count() == 0


def test_phrases_and_ranks_from_one_index_shuffle_no_texts(spark, monkeypatch):
    """What stages shuffle stays far below the texts, for phrases with an index and without, and for ranks; results are those of the plain forms, whether asked tokens stand in a filter or in a join."""
    sc = spark.sparkContext
    shuffled = lambda: sum(s.shuffleWriteBytes() for s in (lambda a: [a.apply(i) for i in range(a.size())])(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())))
    rng = random.Random(3)
    texts = [(f"t/{i:03d}.md", " ".join(f"{rng.getrandbits(60):x}" for _ in range(1500)) + (" One phrase of Straße words" if i % 9 == 0 else " phrase of the words")) for i in range(300)] + [("t/null.md", None)]
    size = sum(len(x or "") for _, x in texts)
    docs = spark.createDataFrame(texts, "path string, content string").repartition(4)
    docs.write.format("noop").mode("overwrite").save()
    phrases = [(1, "phrase of Straße words"), (2, "one phrase of straße wor"), (3, "phrase of the words"), (4, "words phrase of"), (5, "")]
    p = spark.createDataFrame(phrases, "query_id long, phrase string")
    q = p.withColumnRenamed("phrase", "query")
    tokens = lambda c: q.select(F.explode(F.split(F.lower(c), " ")).alias("token"))
    from docweave.operators.graph import cut

    held = cut(docs)
    for asked in (lexical_index.ASKED, 1):
        monkeypatch.setattr(lexical_index, "ASKED", asked)
        before = shuffled()
        index = lexical_index.build_index(held, tokens("query").where("token <> 'of'"), spark.createDataFrame([("of",), ("strasse",)], "token string"))
        assert index.tokens.where("token = 'of'").isEmpty() and not index.documents.where("array_contains(in_content, 'of')").isEmpty()
        for fold in (False, True):
            f = (lambda x: x.lower().replace("ß", "ss")) if fold else (lambda x: x)
            want = {(i, path) for i, x in phrases for path, text in texts if x and text and f(x) in f(text)}
            for own in (index, None):
                assert {tuple(r) for r in retrieval.phrase_hits(p, held, fold, own).collect()} == want
        index.drop()
        got = {}
        for r in retrieval.rank_documents(q, held, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["path"], round(r["score"], 9)))
        assert got == plain(texts, phrases, 5)
        assert shuffled() - before < 0.2 * size
