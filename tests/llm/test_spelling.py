"""Spelling variants: the index against brute force, the query against SQL, dealt groups, odd tables."""

import zlib
from collections import Counter

import numpy as np
import pytest

from docweave.llm import spelling
from docweave.llm.spelling import SuffixRanks

from ..conftest import assert_same


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def invented(n, seed, letters="abcé", low=4, high=9):
    rng = np.random.default_rng(seed)
    return sorted({"".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(n)})


def test_query_equals_sql(spark, small):
    assert_same(spelling.op11_spelling(spark, small), spelling.OP11_SQL, small)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_ranks_find_one_error_in_front_of_the_exact_half(seed):
    words = invented(400, seed) + ["ab", "ba", "q" * 3000, "q" * 2999 + "r", "q" * 3001]
    words = sorted(set(words))
    asked = words[::2] + ["zzzzzz", "abzabc"]  # also words that no index word equals, and a code point that none holds
    exact = np.array([len(w) - len(w) // 2 for w in asked], np.int64)
    known = set(words)
    q, w = SuffixRanks(words).one_error(asked, exact, np.array([x in known for x in asked], np.int64))
    got = {(asked[i], words[j]) for i, j in zip(q, w)}
    want = {(a, b) for a, k in zip(asked, exact) for b in words if len(b) in (len(a), len(a) + 1) and one_edit(a, b) and b.endswith(a[len(a) - k :])}
    assert {(a, b) for a, b in got if a != b} == want


def brute(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best is not None and words[best] >= 10 * n else None, n, len(near))
    return out


@pytest.mark.parametrize("group_words", [60_000, 3])
def test_pairs_equal_brute_force_however_groups_are_dealt(spark, monkeypatch, group_words):
    monkeypatch.setattr(spelling, "INDEX_WORDS", 50 if group_words == 3 else spelling.INDEX_WORDS)
    words = {w: int(n) for w, n in zip(invented(300, 9), np.random.default_rng(9).integers(1, 400, 400))}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r["word"], r["near"], r["near_n"]) for r in spelling.pairs(rows, group_words).collect()}
    assert got == {(a, b, words[b]) for a in words for b in words if one_edit(a, b)} and got
    if group_words != 3:
        found = {r["word"]: r for r in spelling.variants(rows).collect()}
        for w, (form, n, near) in brute(words).items():
            r = found[w]
            root = w
            while brute_form := brute(words)[root][0] if len(words) < 50 else found[root]["form"]:
                root = brute_form
            assert (r["form"], r["n"], r["n_near"], r["root"]) == (form, n, near, root) and r["form_n"] == (words[form] if form else None)


def test_roots_follow_chains(spark):
    chain = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefghijk": 10_000, "other": 5}
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert got == {w: "abcdefghijk" if w != "other" else "other" for w in chain}


def test_words_of_odd_documents(spark):
    long = "verylongword" * 2000
    rows = [(1, "Überraschung überraschung ÜBERRASCHUNG"), (2, None), (3, ""), (None, "Wordswords wordswords"), (4, f"{long} {long} short word×word÷ten"), (4, "repeated repeated"), (4, "repeated repeated"), (5, "naïveté-naïveté123naïveté")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n long, word string")
    want = Counter()
    for doc_id, text in rows:
        for run in spelling.RUNS.findall(text or ""):
            raw = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{raw}".encode())
            w = raw[: h % len(raw)] + raw[h % len(raw) + 1 :] if h % 31 == 0 else raw
            assert w == spelling.damaged(doc_id, raw)
            if len(w) >= 7:
                want[w] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2} and long in got
    assert spelling.word_counts(docs.limit(0)).count() == 0 and spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([("same", 3, 1), ("same", 5, 2), (None, 4, 3), ("", 4, 4), ("none", None, 5), ("sane", 60, 6)], "word string, n long, form long")
    assert {(r["word"], r["form"], r["n"]) for r in spelling.variants(odd).collect()} == {("same", "sane", 5), ("sane", None, 60)}
