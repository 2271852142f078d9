"""Toxicity, quality, near-duplicates, mixing, sharding, chat, the pipeline: brute force, held-out accuracy, odd tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import chat, common, minhash, mixing, quality, sharding, toxicity

from ..conftest import DATA, assert_same


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta", "s1"), (2, "ALPHA beta gamma delta epsilon zeta eta theta", "s1"), (2, "ALPHA beta gamma delta epsilon zeta eta theta", "s1"), (3, None, None), (4, "", "s2"), (5, " \n\t ", "s2"), (6, "one", "s2"), (7, "One", None)]
    rows += [(None, "alpha beta gamma delta epsilon zeta eta theta", "s1"), (8, "w " * 60_000 + "end", "s3"), (9, "idiot moron scum you idiot", None), (10, "alpha beta gamma delta epsilon zeta eta theta iota", "s9")]
    df = spark.createDataFrame([(*r, "de", 1, 2, 3.0, "x", [1], 0) for r in rows], "doc_id long, text string, source string, lang string, label int, shard int, score double, size string, draws array<int>, component_id int")
    return df


def labels(spark, name="labels"):
    return spark.read.parquet(f"{DATA}/sf0.1/{name}.parquet")


# --- classifiers ----------------------------------------------------------------------------------------------------


def held_out_accuracy(spark, scored, column, fold, folds):
    got = scored.join(labels(spark), "doc_id").select("doc_id", "held_out", "score", "predicted", column).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) and 0 <= r["score"] <= 1
    got = [r for r in got if r["held_out"]]
    y, s = np.array([r[column] for r in got]), np.array([r["score"] for r in got])
    order = np.argsort(np.argsort(s))
    n = y.sum()
    auc = (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))
    return float(np.mean([r["predicted"] == r[column] for r in got])), auc


def test_toxicity_of_held_out_documents(spark):
    accuracy, auc = held_out_accuracy(spark, toxicity.op1_toxicity(spark, f"{DATA}/sf0.1"), "toxic", 1, 3)
    assert accuracy > 0.97 and auc > 0.93


def test_quality_of_held_out_documents(spark):
    accuracy, auc = held_out_accuracy(spark, quality.op7_quality(spark, f"{DATA}/sf0.1"), "quality", 0, 5)
    assert accuracy > 0.98 and auc > 0.98


def test_toxicity_of_odd_tables(spark, odd):
    none = labels(spark).limit(0)
    model = toxicity.fit(odd, none)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and next(r for r in got if r["doc_id"] == 9)["score"] >= 0.7
    assert all(r["score"] < 0.7 for r in got if r["doc_id"] != 9)
    kept = toxicity.drop_toxic(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), none)).count() == 0


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    accuracy = [0.95, 0.9, 0.85, 0.6, 0.6]
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y) * 2 - 1 for a in accuracy], axis=1)
    votes = np.hstack([votes, votes[:, 3:4], votes[:, 3:4]]).astype(np.int8)  # two voters repeat a weak one
    m = toxicity.LabelModel()
    p = m.fit(votes, 0.3)
    assert ((p > 0.5) == y).mean() > 0.95 and m.toxic[0, 2] > m.toxic[3, 2]
    assert m.toxic[0, 2] == pytest.approx(0.95, abs=0.03) and m.clean[0, 2] == pytest.approx(0.05, abs=0.03)
    # the repeated voters hang on each other, independent ones on none
    assert {frozenset((i, j)) for i, j in enumerate(m.parent) if j >= 0} <= {frozenset(x) for x in ((3, 5), (3, 6), (5, 6))} and (m.parent >= 0).sum() == 2


def test_dependent_voters_are_a_factor_of_the_model():
    """One voter repeats another most of the time, four are independent: the dependency is found, and the posterior of each vote pattern is the share of truth among its rows."""
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.4
    vote = lambda accuracy: np.where(rng.random(len(y)) < accuracy, y, ~y) * 2 - 1
    a = vote(0.75)
    b = np.where(rng.random(len(y)) < 0.8, a, vote(0.75))
    votes = np.stack([a, b, vote(0.9), vote(0.85), vote(0.85), vote(0.8)], 1).astype(np.int8)
    m = toxicity.LabelModel()
    p = m.fit(votes, 0.4)
    assert {frozenset((i, j)) for i, j in enumerate(m.parent) if j >= 0} == {frozenset((0, 1))}
    patterns = [(votes == x).all(1) for x in np.unique(votes, axis=0)]
    assert all(abs(p[r].mean() - y[r].mean()) < 0.1 for r in patterns if r.sum() > 200)


def test_voters_see_texts_and_no_labels():
    words, stems = ["bad", "idiot"], [("stem", 1)]
    lex = toxicity.Lexicon(words, stems)
    texts = ["you idiot idiot", "all fine here", "THE VOICE THAT SHOUTS AND SHOUTS", "so so so so"]
    v = toxicity._votes([lex.hits(t) for t in texts], toxicity.lexicon_of(words, stems), [toxicity.manner(t) for t in texts])
    at = {n: i for i, n in enumerate((*toxicity.LEXICONS, *toxicity.PATTERNS))}
    assert v[0, at["insults_en"]] == v[0, at["address"]] == v[0, at["row"]] == v[0, at["several"]] == 1 and v[1, at["silence"]] == -1
    assert v[2, at["shouting"]] == 1 and v[3, at["repeating"]] == 1 and v[1, at["shouting"]] == v[1, at["repeating"]] == 0


def test_stems_and_words_are_found_once_or_twice():
    lex = toxicity.Lexicon(["bad"], [("stem", 2)])
    assert lex.hits("BAD! badly stemming")[0] == [(0, 1)] and lex.hits("stema stemb")[0] == [(1, 2)] and lex.hits("x" * 10)[0] == [] and lex.hits(None) == ([], 0, 0, 0)
    assert lex.hits("you bad bad")[1:] == (1, 1, 3)


def test_trees_predict_as_they_were_grown():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < 0)).astype(float)
    t = quality.grow(x[:2000], y[:2000], trees=60, depth=3)
    p = t.predict(x)
    slow = []
    for row in x[:50]:
        raw = t.base
        for f, th, leaf in zip(t.feature, t.threshold, t.leaf):
            k = 0
            for _ in range(3):
                k = 2 * k + 1 + int(row[f[k]] > th[k])
            raw += leaf[k - 7]
        slow.append(1 / (1 + np.exp(-raw)))
    assert np.allclose(p[:50], slow) and ((p[2000:] > 0.5) == y[2000:]).mean() > 0.95
    one = quality.grow(x[:10], np.ones(10))
    assert (one.predict(x[:3]) > 0.5).all() and len(quality.grow(x[:0], y[:0]).predict(x[:0])) == 0


def test_quality_of_odd_tables(spark, odd):
    none = labels(spark).limit(0)
    trees = quality.fit(odd, none)
    assert quality.score(odd, trees).count() == odd.count() and quality.keep_good(odd, none).columns == odd.columns
    assert len(quality.statistics(None)) == len(quality.statistics("a b. c")) == len(quality.STATISTICS)


# --- near-duplicates ------------------------------------------------------------------------------------------------


def brute(rows, size=2):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in ks}


def check_groups(spark, rows, size=2):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size).collect()}
    assert got == brute(rows, size)


def test_near_duplicates_of_the_small_table(spark, small):
    assert_same(minhash.op8_minhash(spark, small), minhash.OP8_SQL, small)


def test_families_and_chains(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(6):
        base = rng.choice(words, int(rng.integers(30, 200))).tolist()
        cur = list(base)
        for c in range(40):
            own = list(base if f % 2 else cur)  # copies of one text, or each a copy of the one before
            for _ in range(max(1, int(len(own) * rng.choice([0.02, 0.05, 0.09, 0.14])))):
                own[int(rng.integers(len(own)))] = str(rng.choice(words))
            cur = own
            rows.append((len(rows), " ".join(own)))
    shared = rng.choice(words, 40).tolist()
    rows += [(len(rows) + i, " ".join(shared + rng.choice(words, 18).tolist())) for i in range(60)]  # a passage that many share
    monkeypatch.setattr(minhash, "LIST_ROWS", 4)  # so that lists and clusters go block against block
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 700)
    check_groups(spark, rows)


def family(spark, n):
    head, tail = " ".join(f"h{i}" for i in range(10)), " ".join(f"t{i}" for i in range(9))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(head + " own"), "id", F.lit(" " + tail)).alias("text"))  # 17 of 21 shingles are shared


def test_large_families_of_short_texts_go_in_bounded_blocks(spark, monkeypatch):
    n, plain = 100_000, minhash._similar

    def bounded(sets, left, right):
        assert len(sets) <= 2 * minhash.BLOCK_ROWS and len(left) == 1, (len(sets), len(left))  # the pivot joins all: as many comparisons as members
        return plain(sets, left, right)

    monkeypatch.setattr(minhash, "_similar", bounded)
    docs = family(spark, n)
    clusters = docs.select("doc_id", F.lit(0).cast("long").alias("cluster"), F.lit(19).cast("long").alias("n"))
    got = minhash.components(minhash._confirm(clusters, docs, 2)).agg(F.count("node"), F.max("component")).first()
    assert tuple(got) == (n, 0)


def test_long_token_lists_go_in_bounded_blocks(spark, monkeypatch):
    """One list of 100,000 documents in three families that share the token only: all of a family are joined, families are not."""
    n, plain = 100_000, minhash._collide

    def bounded(sigs, left, right):
        assert len(sigs) <= 4 * minhash.LIST_ROWS, len(sigs)
        return plain(sigs, left, right)

    monkeypatch.setattr(minhash, "_collide", bounded)
    kinds = [np.random.default_rng(k).integers(0, 256, 64, dtype=np.uint8).tobytes() for k in range(3)]
    kind = F.when(F.col("id") % 1000 < 990, 0).when(F.col("id") % 1000 < 996, 1).otherwise(2)
    sig = F.element_at(F.array(*map(F.lit, map(bytearray, kinds))), kind + 1)
    posted = spark.range(n).select(F.lit(5).cast("long").alias("token"), F.col("id").alias("doc_id"), sig.alias("sig"), F.lit(n).cast("long").alias("length"))
    got = minhash.components(minhash._candidates(posted)).groupBy("component").agg(F.count("node").alias("n")).collect()
    assert {(r["component"], r["n"]) for r in got} == {(0, 99_000), (990, 600), (996, 400)}


def test_near_duplicates_of_a_large_family(spark):
    got = minhash.near_duplicates(family(spark, 3000), 2).agg(F.max("component_id"), F.sum(F.col("kept").cast("int")), F.count("doc_id")).first()
    assert tuple(got) == (0, 1, 3000)


def test_blocks_of_few_rows_find_the_same(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[:20], f"x{i % 30}", *words[20 : 20 + i % 7]])) for i in range(200)]
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    monkeypatch.setattr(minhash, "LIST_ROWS", 5)
    check_groups(spark, rows)


def test_small_and_odd_texts(spark, odd):
    texts = ["", None, " ", "a", "A", "a", "a b", "A  b", "a b c", "b c", "a b c d e f", "a b c d e f g", "a b c d e f g h", "é É", "É É", "x y", "a b a b a b"]
    check_groups(spark, list(enumerate(texts)))
    check_groups(spark, list(enumerate(texts)), 5)
    got = minhash.near_duplicates(odd, 2).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == by[1]["component_id"] == by[10]["component_id"] == 1 and not by[2]["kept"] and by[7]["component_id"] == 6 and by[3]["n_shingles"] == 0 and by[4]["component_id"] == 4
    assert by[None]["component_id"] is None and by[None]["kept"]
    kept = minhash.drop_near_duplicates(odd, 2)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect()) == [-1, 1, 3, 4, 5, 6, 8, 9]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 7), (200, 201), (201, 202), (202, 200), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 0, 200: 200, 201: 200, 202: 200}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = np.concatenate((a[:178], rng.integers(0, 1 << 63, 22, dtype=np.uint64)))  # similarity 178 / 222 = 0.80
        errors.append((minhash.signature(np.unique(a)) == minhash.signature(np.unique(b))).sum())
    assert abs(np.mean(errors) / 64 - 178 / 222) < 0.02 and min(errors) >= minhash.MATCHES


# --- mixing ---------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, pool, target = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: pool * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            pool -= target[s]
            left.discard(s)
    return target


def test_mix_meets_its_targets(spark):
    d = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = mixing.op3_mixing(spark, d).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
        taken[r["source"]] += r["taken"]
    assert len(got) == docs.count() and all(abs(taken[s] - want[s]) < 0.01 * sizes[s] for s in sizes)
    again = {r["doc_id"]: (r["taken"], r["shards"]) for r in mixing.op3_mixing(spark, d).collect()}
    assert again == {r["doc_id"]: (r["taken"], r["shards"]) for r in got}


def test_mix_of_odd_tables(spark, odd):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == odd.count() and all(r["copies"] == len(r["draws"]) <= 2 and (r["size"] or not r["copies"]) for r in plan)
    mixed = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, "mix_shard", "mix_place"] and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mix_plan(odd.limit(0)).count() == 0
    blank = mixing.mix_plan(odd.where("doc_id IN (3, 4)")).collect()
    assert [(r["target"], r["copies"]) for r in blank] == [(0.0, 0), (0.0, 0)]


def test_quotas_split_like_draws_without_replacement(spark):
    quotas = spark.createDataFrame([(1, 300), (2, 100), (3, 0), (4, 57)], "source_rank long, quota long")
    got = []
    for seed in range(24):
        rows = mixing.split_quotas(quotas, 4, seed, together=2 if seed % 2 else 512).collect()  # sources in several groups, or in one
        by = {(r["source_rank"], r["shard"]): r["n"] for r in rows}
        assert all(sum(by[s, k] for k in range(4)) == q for s, q in ((1, 300), (2, 100), (3, 0), (4, 57)))
        totals = [sum(by[s, k] for s in (1, 2, 3, 4)) for k in range(4)]
        assert max(totals) - min(totals) <= 1
        got.append(by[2, 0])
    # hypergeometric: mean 25, variance 100/457 * 357/457 * 114 * (343/456)
    assert abs(np.mean(got) - 25) < 2.8 and 6 < np.var(got) < 32  # 24 draws


# --- sharding -------------------------------------------------------------------------------------------------------


def plain_lpt(sizes, shards):
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        k = min(range(shards), key=lambda k: (loads[k], k))
        loads[k] += s
    return loads


@pytest.mark.parametrize("most", [3, 50, 1000, 10**6])
def test_lpt_against_a_plain_loop(most):
    """By classes of equal sizes, loads are those of the plain loop over single groups; a class's groups are all given out."""
    rng = np.random.default_rng(most)
    for n in (1, 5, 200, 3000):
        sizes = np.minimum(rng.integers(1, most + 1, n), rng.integers(1, most + 1, n)).tolist()
        count = Counter(sizes)
        placed = sharding.lpt([(s, k, float(s * k)) for s, k in count.items()], 8)
        loads = [0] * 8
        for s, k in count.items():
            ends, owners, cycle = placed[s]
            for number in range(k):
                early = sum(e <= number for e in ends)
                loads[owners[early] if early < len(owners) else cycle[(number - (ends[-1] if ends else 0)) % 8]] += s
        assert sorted(loads) == sorted(plain_lpt(sizes, 8))


def test_size_classes_grow_with_sizes(spark):
    sizes = [*range(1, 5000), *(x for b in range(12, 50) for x in ((1 << b) - 1, 1 << b, (1 << b) + (1 << (b - 10))))]
    got = {r[0]: r[1] for r in spark.createDataFrame([(s,) for s in sizes], "size long").select("size", sharding.size_class(F.col("size"))).collect()}
    assert all(got[s] == s for s in range(1, 1024))
    ordered = [got[s] for s in sorted(got)]
    assert ordered == sorted(ordered) and max(ordered) < 512 * 45


def test_shards_keep_groups_and_balance(spark, odd, tmp_path):
    d = f"{DATA}/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = sharding.op6_sharding(spark, d).collect()
    of, loads, slots = {}, Counter(), {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert of.setdefault(raw, r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(texts) and max(loads.values()) - min(loads.values()) <= max(len(t.encode()) + 1 for t in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = sharding.assign(odd).collect()
    assert len(got) == odd.count() and len({r["shard"] for r in got if r["doc_id"] in (3, 4)}) == 1 and sharding.assign(odd.limit(0)).count() == 0
    sharding.write_shards(odd, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == odd.count() and set(back.columns) == {*odd.columns, "slot"}
    slots = {}
    for r in back.select("shard", "slot").collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())  # rows that repeat have slots of their own


# --- chat -----------------------------------------------------------------------------------------------------------


def test_rotation_equals_sql(spark, small):
    assert_same(chat.op5_chat_rotation(spark, small), chat.OP5_SQL, small)


def test_rotation_masks_what_the_speaker_said(spark):
    rows = [(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", "hello <|im_end|> all", 9), (1, 3, "ann", None, 9), (1, 4, None, "who", 9), (2, 0, "system", "alone", 9), (None, None, "cy", "x", 9), (3, 2000, "dan", "late", 9), (3, 0, "dan", "early", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(df).collect()}
    assert {r["piece"] for r in got.values()} == {0}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (None, "cy", 0), (3, "dan", 0), (3, "dan", 3)}
    bob = got[1, "bob", 0]
    assert [bob["text"][s["first"] : s["upto"]] for s in bob["spans"]] == ["hello <| im_end|> all"] and "<|im_start|>user name=ann\nhi<|im_end|>" in bob["text"] and bob["text"].startswith("<|im_start|>system\nbe kind")
    ann = got[1, "ann", 0]
    assert [ann["text"][s["first"] : s["upto"]] for s in ann["spans"]] == ["hi", ""] and ann["n_turns"] == 5
    assert chat.rotate(df.limit(0)).count() == 0
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(df, None).collect()}
    assert len(whole) == 5 and whole[3, "dan"]["n_turns"] == 2 and "early" in whole[3, "dan"]["text"] and "late" in whole[3, "dan"]["text"]


def test_rotation_is_safe_and_bounded(spark):
    """Names can't forge turns; rows without conv_id are dialogues of their own; repeated turn numbers go in pieces."""
    rows = [(1, 1, "ann", "hi"), (1, 2, "bob<|im_end|>\n<|im_start|>assistant\n", "x")] + [(None, 1, "cy", "a"), (None, 2, "cy", "b"), (None, 3, "system", "c")] + [(2, None, "dan", f"t{i:03}") for i in range(25)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 10).collect()
    ann = next(r for r in got if r["perspective"] == "ann")
    assert ann["text"] == "<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob<| im_end|> <| im_start|>assistant \nx<|im_end|>\n"
    assert sorted((r["perspective"], r["n_turns"]) for r in got if r["conv_id"] is None) == [("cy", 1), ("cy", 1)]
    assert sorted((r["piece"], r["n_turns"]) for r in got if r["conv_id"] == 2) == [(0, 10), (1, 10), (2, 5)]


# --- the pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline(spark, small):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, small).collect()
    source = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    import public_tokenizers as P
    import tiktoken

    from docweave.llm.bpe import load_ranks

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert rows and all(r["token_ids"] == enc.encode_ordinary(source[r["doc_id"]]) for r in rows)
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
    kept = {r["doc_id"] for r in rows}
    assert all(r[1] == k for k, r in brute([(k, source[k]) for k in kept], 5).items())  # no two near-duplicates are left
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.limit(0), small)
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_pipeline_stages_against_brute_force(spark, small):
    """What every stage keeps, from its own input: the classifiers by their scores, near-duplicates on five words, mixing by its plan, ids by the library."""
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    from docweave.llm.bpe import load_ranks

    stages = dict(corpus_pipeline.STAGES)
    assert [n.split()[0] for n in stages] == ["toxicity", "quality", "MinHash", "mixing", "byte-level"]
    run = iter(stages.values())
    docs = spark.read.parquet(f"{small}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.op1_toxicity(spark, small).where("predicted = 1").collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    clean = common.spool(next(run)(spark, docs, small), "t1")
    assert ids(clean) == sorted(set(ids(docs)) - toxic) and toxic
    good = common.spool(next(run)(spark, clean, small), "t2")
    trees = quality.fit(clean, common.table(spark, small, "labels"))  # a stage learns from its own input
    bad = {r["doc_id"] for r in quality.score(clean, trees).where("score < 0.3").collect()}
    assert ids(good) == sorted(set(ids(clean)) - bad) and bad
    text = {r["doc_id"]: r["text"] or "" for r in good.collect()}
    five, two = brute(list(text.items()), 5), brute(list(text.items()), 2)
    one = common.spool(next(run)(spark, good, small), "t3")
    assert ids(one) == sorted(k for k, r in five.items() if r[1] == k)
    only_at_two = [k for k in text if two[k][1] != k and five[k][1] == k]
    assert only_at_two and set(only_at_two) <= set(ids(one))  # documents that are alike in pairs of words only stay
    mixed = common.spool(next(run)(spark, one, small), "t4")
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(one).collect()}
    assert Counter(ids(mixed)) == Counter({k: c for k, c in plan.items() if c})
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = next(run)(spark, mixed, small).collect()
    assert sorted(r["doc_id"] for r in last) == ids(mixed) and all(r["token_ids"] == enc.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) for r in last)


def test_pipeline_stages_take_odd_rows(spark, odd, small):
    import corpus_pipeline

    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    names = docs.columns
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.spool(stage(spark, docs, small), "odd-stage")
        assert name.startswith("byte-level") or docs.columns == names
        assert docs.count() <= (2 * left if name.startswith(("mixing", "byte")) else left)


def test_held_out_rows(spark):
    df = spark.createDataFrame([(k,) for k in (*range(50), -3, None)], "doc_id long")
    for folds, fold in ((3, 1), (5, 0)):
        got = {r[0]: r[1] for r in df.select("doc_id", common.held_out(F.col("doc_id"), folds, fold)).collect()}
        assert got == {k: zlib.crc32(("" if k is None else str(k)).encode()) % folds == fold for k in got}


def test_shared_dir_is_the_sessions(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert common.shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())
    df = common.spool(spark.range(3), "t")
    assert df.count() == 3 and isinstance(F.col("x"), type(F.lit(1)))
