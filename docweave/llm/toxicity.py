"""Toxicity by weak supervision.

1. Voters. Lexicons: fixed insults by language, and words and word beginnings (by length) that occur (almost) only in toxic texts, mined from
   labelled rows. Patterns: several hits, several kinds, dense hits, hits in a row, hits addressed to a reader, silence, shouting, repetition.
   A voter says toxic, clean or nothing. Labels serve to mine lexicons only; no voter sees one.
2. Label model. A generative model of the votes gets each voter's accuracies by expectation-maximisation. Correlations are factors of it: within a
   class voters hang together in the tree of the strongest dependencies, each given the vote of the one above. Posteriors come from votes alone.
3. Classifier. A linear (logistic) model over lexicon counts is trained on the posterior labels and scores every whole text.

Only the sample that steps 1 and 2 learn from is bounded (FIT_ROWS labelled rows, those with the smallest hash of doc_id); all texts are scored.
Neither labels, lang, source nor doc_id are inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_text, held_out, lean, ship, spool, table

FOLDS, FOLD = 3, 1
THRESHOLD = 0.7
#: Most labelled rows that the voters, the label model and the classifier are fitted on.
FIT_ROWS = 20_000
#: Most lexicon entries.
MOST_TERMS = 400
#: Beginnings of words that may be lexicon entries, in characters.
STEMS = (4, 5, 6, 7)
MOST_LEAST = 3

#: Insults that count as lexicon entries even where no label shows it.
INSULTS = {
    "en": "idiot idiots moron morons stupid scum loser losers pathetic disgusting worthless trash clown imbecile dumbass bastard scumbag".split(),
    "de": "arschloch dummkopf vollidiot abschaum wichser".split(),
    "fr": "connard crétin salaud abruti".split(),
    "es": "gilipollas imbécil cabrón pendejo escoria".split(),
}
#: Words that address a reader.
ADDRESS = frozenset("you your youre u du dich dir ihr tu te toi vous tú usted vosotros".split())

#: The voters. Lexicons say toxic where one of their entries occurs and nothing otherwise; see _votes for the patterns.
LEXICONS = ("words", "stems_4", "stems_5", "stems_6", "stems_7", *(f"insults_{k}" for k in INSULTS))
PATTERNS = ("several", "dense", "row", "address", "kinds", "silence", "shouting", "repeating")

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str | None) -> str:
    """The text in lower case, with a blank for every ASCII character that is no letter."""
    return (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).decode("utf-8", "replace")


class Lexicon:
    """Counts entries in texts in one pass. A word entry matches whole words, a stem entry the beginnings of words; a stem that clean texts use now and then
    counts only from its second or third occurrence in a text on."""

    def __init__(self, words: list[str], stems: list[tuple[str, int]]):
        import ahocorasick

        self.words, self.stems = words, [w for w, _ in stems]
        self.least = [1] * len(words) + [n for _, n in stems]
        self.size = len(words) + len(stems)
        self.trie = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.trie.add_word(f" {w} ", i)
        for i, w in enumerate(self.stems):
            self.trie.add_word(f" {w}", len(words) + i)
        if self.size:
            self.trie.make_automaton()

    def hits(self, text: str | None) -> tuple[list[tuple[int, int]], int, int, int]:
        """(entry, count) pairs; hits next to each other; hits next to a word of address; words."""
        words = plain(text).split()
        n = len(words)
        if not self.size or not n:
            return [], 0, 0, n
        s = f" {' '.join(words)} "
        found = [(end, i) for end, i in self.trie.iter(s)]
        if not found:
            return [], 0, 0, n
        counts = Counter(i for _, i in found)
        counts = {i: c for i, c in counts.items() if c >= self.least[i]}
        # the words that were hit, by the place of the blank before them
        places = set()
        for end, i in found:
            if i not in counts:
                continue
            entry = self.words[i] if i < len(self.words) else self.stems[i - len(self.words)]
            places.add(end - len(entry) - (1 if i < len(self.words) else 0))
        row = address = 0
        for p in places:
            row += s.find(" ", p + 1) in places
            address += s[s.rfind(" ", 0, p) + 1 : p] in ADDRESS
        return sorted(counts.items()), row, address, n


def _training_rows(docs: DataFrame, labels: DataFrame, column: str, folds: int, fold: int, most: int) -> DataFrame:
    """text, label (0 or 1) and key (a hash of the text) of at most ``most`` labelled rows that are not held out. A doc_id with several labels has the largest of them."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(column).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    few = docs.select(docs["doc_id"].alias("_doc"), docs["text"].alias("_text"))  # other columns of docs may have any name
    few = few.join(F.broadcast(some), F.col("_doc") == F.col("_id"))
    one = few.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("text"), F.first("label").alias("label"))  # a doc_id may repeat; most stays the bound
    return one.select("text", "label", F.xxhash64("text").alias("key"))


def _one_of_each_family(rows: DataFrame) -> set[int]:
    """Keys of training rows such that hardly two are copies of each other: a row falls out if one of four MinHash values of its three-word
    sequences is that of a row before it. Else the words of a text with many copies would pass for signs of its label."""

    def run(batches):
        for b in batches:
            found = []
            for text in each_text(b.column(0)):
                w = plain(text).split()
                ids = np.array([zlib.crc32(x.encode()) for x in w] or [0], np.uint64)
                h = ids if len(ids) < 3 else (ids[:-2] * np.uint64(0x9E3779B97F4A7C15) + ids[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + ids[2:] * np.uint64(0x165667B19E3779F9))
                h ^= h >> np.uint64(29)
                found.append([int((h * np.uint64(m)).min() >> np.uint64(1)) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)])
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(found, pa.list_(pa.int64()))], ["key", "mins"])

    seen: set[tuple[int, int]] = set()
    kept = set()
    for r in sorted(rows.mapInArrow(lean(run), "key long, mins array<long>").collect(), key=lambda r: r["key"]):  # FIT_ROWS at most, five numbers each
        mine = set(enumerate(r["mins"]))
        if not mine & seen:
            kept.add(r["key"])
        seen |= mine
    return kept


def _terms(text: str | None, wanted: frozenset | None = None) -> set[str]:
    """What a text says for mining: =word for each word, and a digit before each stem for every number of occurrences (1 to MOST_LEAST) that it reaches."""
    words = plain(text).split()
    if wanted is None:
        terms = {"=" + w for w in set(words) if len(w) < 40}
    else:
        terms = {t for t in ("=" + w for w in set(words)) if t in wanted}
    for n in STEMS:
        starts = (w[:n] for w in words if len(w) >= n)
        if wanted is not None:
            starts = (x for x in starts if "1" + x in wanted)
        for x, c in Counter(starts).items():
            terms.update(f"{m}{x}" for m in range(1, min(c, MOST_LEAST) + 1))
    return terms


def _mine(rows: DataFrame, seeds: list[str]) -> tuple[list[str], list[tuple[str, int]]]:
    """Words and stems that are nearly always in toxic texts, from document counts by class: first of all terms of toxic texts, then of the frequent ones in clean texts."""
    totals = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    toxic, n = int(totals[0] or 0), int(totals[1] or 0)
    if not toxic or toxic == n:
        return sorted(seeds), []
    enough = max(4, toxic // 200)

    def counted(some: DataFrame, wanted: frozenset | None) -> dict[str, int]:
        def run(batches):
            seen: Counter = Counter()
            for b in batches:
                for text in each_text(b.column(0)):
                    seen.update(_terms(text, wanted))
                if len(seen) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        counts = some.mapInArrow(lean(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in counts.where(F.col("n") >= (enough if wanted is None else 1)).collect()}

    in_toxic = counted(rows.where("label = 1"), None)  # terms of at least 1 in 200 of the sample's toxic texts: bounded with the sample
    in_clean = counted(rows.where("label = 0"), frozenset(in_toxic))
    pure = {t: k for t, k in in_toxic.items() if k >= 19 * in_clean.get(t, 0)}
    words: list[str] = []
    stems: dict[str, int] = {}
    for t in sorted(pure, key=lambda t: (-pure[t], len(t), t)):
        kind, term, k = t[0], t[1:], pure[t]
        if len(words) + len(stems) >= MOST_TERMS:
            break
        if any(term[:m] in stems for m in STEMS if m <= len(term)):
            continue  # a shorter stem says it already
        if kind == "=":
            words.append(term)
        # a stem that one longer stem, or one whole word, makes up nearly all of is left to that
        elif not any(o[1:].startswith(term) and pure[o] >= 0.97 * k for o in pure if o[0] == kind and len(o) == len(t) + 1 or o[0] == "="):
            stems[term] = int(kind)
    return sorted(set(words) | set(seeds)), sorted(stems.items())


def lexicon_of(words: list[str], stems: list[tuple[str, int]]) -> list[int]:
    """The lexicon (a number in LEXICONS) of every entry."""
    insults = {w: LEXICONS.index(f"insults_{k}") for k, ws in INSULTS.items() for w in ws}
    return [insults.get(w, 0) for w in words] + [LEXICONS.index(f"stems_{len(w)}") for w, _ in stems]


def manner(text: str | None) -> tuple[float, int]:
    """Share of capitals among ASCII letters (0 below 20 letters), and the most often that a word follows itself."""
    raw = (text or "").encode("utf-8", "replace")
    letters = np.frombuffer(raw, np.uint8)
    letters = letters[((letters | 32) >= 97) & ((letters | 32) <= 122)]
    run = most = 0
    words = raw.lower().split()
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 0
        most = max(most, run)
    return float((letters < 97).mean()) if len(letters) >= 20 else 0.0, most


def _votes(hits: list, lexicons: list[int], manners: list[tuple[float, int]]) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 none) of LEXICONS and PATTERNS from (pairs, row, address, words) and the manner of each text."""
    v = np.zeros((len(hits), len(LEXICONS) + len(PATTERNS)), np.int8)
    at = {p: len(LEXICONS) + i for i, p in enumerate(PATTERNS)}
    for k, ((pairs, row, address, n), (capitals, run)) in enumerate(zip(hits, manners)):
        total = sum(c for _, c in pairs)
        for i, _ in pairs:
            v[k, lexicons[i]] = 1
        v[k, at["several"]] = 1 if total >= 2 else -1 if total == 0 else 0
        v[k, at["dense"]] = 1 if total >= 0.01 * max(n, 1) and total else -1 if total < 0.001 * max(n, 1) else 0
        v[k, at["row"]] = 1 if row else 0
        v[k, at["address"]] = 1 if address else 0
        v[k, at["kinds"]] = 1 if len(pairs) >= 2 else -1 if not pairs else 0
        v[k, at["silence"]] = 0 if pairs else -1
        v[k, at["shouting"]] = 1 if capitals > 0.5 else 0
        v[k, at["repeating"]] = 1 if run >= 2 else 0
    return v


class LabelModel:
    """A generative model of votes. Within a class a voter says toxic, clean or nothing with its own probabilities, given what the voter above it in a
    dependency tree says (voters without one: by themselves). ``toxic`` and ``clean`` are the probabilities by voter, ``parent`` the tree (-1: none),
    ``correlation`` the dependency that is left between voters within a class, in nats."""

    LEAST = 0.01

    def fit(self, votes: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
        """Returns the posterior probability of toxic for each row. ``prior`` is where the share of toxic rows starts."""
        n, m = votes.shape
        code = votes.astype(np.int64) + 1
        says = np.stack([votes == -1, votes == 0, votes == 1], axis=2).astype(float)
        flat = says.reshape(n, 3 * m)
        usual = np.array([[1.5, 1.0, 0.5], [0.5, 1.0, 1.5]])
        # at the start, voters that always say the same are one voter, or they would be mistaken for the class
        centred = votes - votes.mean(0)
        spread = np.sqrt((centred**2).mean(0)) + 1e-6
        score = votes.astype(float) @ (1 / np.maximum(1, ((centred.T @ centred) / max(n, 1) / np.outer(spread, spread) > 0.97).sum(1)))
        p = np.where(score > 0, 0.9, np.where(score < 0, 0.05, prior))
        self.parent = np.full(m, -1)
        for stage in range(3):
            for _ in range(rounds):
                q = np.stack([1 - p, p])
                marginal = (q @ flat).reshape(2, m, 3) + usual[:, None, :]
                marginal /= marginal.sum(2, keepdims=True)
                balance = (p.sum() + 10 * prior) / (n + 10)
                logit = np.full(n, np.log(balance / (1 - balance)))
                for i, j in enumerate(self.parent):
                    if j < 0:
                        logit += np.log(marginal[1, i] / marginal[0, i])[code[:, i]]
                    else:
                        pair = [says[:, j].T @ (q[y][:, None] * says[:, i]) + 2 * marginal[y, i] for y in (0, 1)]
                        given = [x / x.sum(1, keepdims=True) for x in pair]
                        logit += np.log(given[1] / given[0])[code[:, j], code[:, i]]
                p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            self.clean, self.toxic = marginal
            self.correlation = self._dependency(flat, p, m)
            if stage < 2:
                self.parent = self._tree(self.correlation)
        return p

    @staticmethod
    def _dependency(flat: np.ndarray, p: np.ndarray, m: int) -> np.ndarray:
        """Mutual information of every two voters given the class."""
        out = np.zeros((m, m))
        for q in (1 - p, p):
            joint = (flat.T @ (q[:, None] * flat) / max(len(p), 1)).reshape(m, 3, m, 3).transpose(0, 2, 1, 3)
            share = max(q.mean(), 1e-9)
            rows, cols = joint.sum(3, keepdims=True), joint.sum(2, keepdims=True)
            ratio = np.divide(joint * share, rows * cols, out=np.ones_like(joint), where=(joint > 0) & (rows * cols > 0))
            out += (joint * np.log(ratio)).sum((2, 3))
        np.fill_diagonal(out, 0)
        return out

    def _tree(self, dependency: np.ndarray) -> np.ndarray:
        """Each voter's parent in the tree (or trees) of the strongest dependencies that reach LEAST."""
        m = len(dependency)
        parent, inside = np.full(m, -1), np.zeros(m, bool)
        for _ in range(m):
            reach = np.where(inside[:, None] & ~inside[None, :], dependency, -1)
            i, j = np.unravel_index(reach.argmax(), reach.shape)
            if reach[i, j] < self.LEAST:  # a new tree begins at the voter that most depends on others
                j = int(np.where(inside, -1, dependency.sum(1)).argmax())
            else:
                parent[j] = i
            inside[j] = True
        return parent


def _features(hits: list, size: int) -> np.ndarray:
    x = np.zeros((len(hits), size + 6))
    for k, (pairs, row, address, n) in enumerate(hits):
        for i, c in pairs:
            x[k, i] = np.log1p(c)
        total = sum(c for _, c in pairs)
        x[k, size:] = (np.log1p(total), len(pairs) > 0, min(1.0, 20 * total / max(n, 1)), row > 0, address > 0, np.log1p(len(pairs)))
    return x


def _logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and intercept of a logistic model on soft labels, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], strength)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The model: lexicon entries, classifier weights, and the label model's accuracies and correlations (for reports).

    Where all labelled rows are of one class, or there is none, nothing can be learned: the fixed insults are the lexicon and the weights are such that two hits
    or one in a short text are toxic.
    """
    ship(docs.sparkSession)
    rows = spool(_training_rows(docs, labels, "toxic", FOLDS, FOLD, fit_rows), "toxicity-rows")
    kept = _one_of_each_family(rows)

    def one_of_each(batches):
        for b in batches:
            yield b.filter(pa.array([k in kept for k in b.column(2).to_pylist()], pa.bool_()))

    rows = spool(rows.mapInArrow(lean(one_of_each), rows.schema).dropDuplicates(["key"]), "toxicity-families")
    words, stems = _mine(rows, [w for ws in INSULTS.values() for w in ws])

    def look(batches):
        lexicon = Lexicon(words, stems)
        for b in batches:
            hits, manners = [], []
            for t in each_text(b.column(0)):
                hits.append(lexicon.hits(t))
                manners.append(manner(t))
            pairs = pa.array([[x for pair in h[0] for x in pair] for h in hits], pa.list_(pa.int32()))
            numbers = [pa.array([h[k] for h in hits], pa.int32()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pairs, *numbers, pa.array([m[0] for m in manners], pa.float64()), pa.array([m[1] for m in manners], pa.int32()), b.column(1)], ["pairs", "row", "address", "n", "capitals", "run", "label"])

    got = rows.mapInArrow(lean(look), "pairs array<int>, row int, address int, n int, capitals double, run int, label int").collect()  # fit_rows at most, a few numbers each
    got.sort(key=lambda r: (r["n"], r["row"], r["address"], r["label"], r["capitals"], r["run"], r["pairs"]))  # as partitions may come in any order
    hits = [(list(zip(r["pairs"][::2], r["pairs"][1::2])), r["row"], r["address"], r["n"]) for r in got]
    size = len(words) + len(stems)
    model = {"words": words, "stems": stems}
    y = np.array([r["label"] for r in got])
    if not len(got) or y.min() == y.max():
        w = np.zeros(size + 7)
        w[size], w[size + 2], w[-1] = 2.0, 3.0, -3.0
        return model | {"weights": w}
    label_model = LabelModel()
    votes = _votes(hits, lexicon_of(words, stems), [(r["capitals"], r["run"]) for r in got])
    posterior = label_model.fit(votes, float(np.clip(y.mean(), 0.01, 0.99)))
    return model | {"weights": _logistic(_features(hits, size), posterior), "toxic_votes": label_model.toxic, "clean_votes": label_model.clean, "parents": label_model.parent, "correlation": label_model.correlation}


def _scorer(model: dict):
    """texts (an Arrow column) -> scores, hits, words of each; made once a task."""
    w, lexicon = model["weights"], Lexicon(model["words"], model["stems"])

    def run(texts: pa.Array) -> tuple[np.ndarray, list[int], list[int]]:
        scores, total, n = np.zeros(len(texts)), [], []
        hits, at = [], 0

        def flush() -> None:
            nonlocal hits, at
            if hits:
                logit = _features(hits, lexicon.size) @ w[:-1] + w[-1]
                scores[at : at + len(hits)] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                at, hits = at + len(hits), []

        for t in each_text(texts):
            h = lexicon.hits(t)
            hits.append(h)
            total.append(sum(c for _, c in h[0]))
            n.append(h[3])
            if len(hits) == 1024:
                flush()
        flush()
        return scores, total, n

    return run


def score(docs: DataFrame, model: dict, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """doc_id, score, hits, n_words of every row. Null text scores like the empty text; a null id stays null. Rows are independent of each other: equal texts (ties, repeated rows, rows of one id) score alike and stand each, in no stated order; texts of any length are read whole; further columns, whatever their names, are neither read nor returned; an empty table gives no rows."""
    ship(docs.sparkSession)

    def run(batches):
        scorer = _scorer(model)
        for b in batches:
            p, hits, n = scorer(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(hits, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "score", "hits", "n_words"])

    return docs.select(docs[id_].alias("doc_id"), docs[text].alias("text")).mapInArrow(lean(run), f"doc_id {docs.schema[id_].dataType.simpleString()}, score double, hits long, n_words long")


def is_toxic(score_: Column) -> Column:
    return (score_ >= THRESHOLD).cast("int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose text is not toxic, with the columns of ``docs``. Only texts go to Python and only scores come back; null and empty texts stay, equal texts share their fate."""
    model = fit(docs, labels)

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(model)
        for texts in batches:
            yield pa.array(scorer(texts)[0])

    return docs.where(toxic(docs["text"]) < THRESHOLD)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", is_toxic(F.col("score")).alias("predicted"), "hits", "n_words")
