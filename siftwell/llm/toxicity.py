"""Toxicity from a learned lexicon, matched with Levenshtein automata over a trie.

Lexicon terms are word stems whose documents are labelled toxic far more often than chance. Each
distinct word of a text is run through a Levenshtein automaton that is intersected with the lexicon
trie, which finds the stem exactly or misspelled by one edit. A match is weighed by a window of
words around it: quotation marks, brackets and words that talk about a term lower it, other matches
nearby raise it. A small logistic model over these sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import map_texts, pinned, prepare, text_of
from siftwell.llm.wordcache import WordCache

#: Labelled documents, toxic and other, that the lexicon and the model are learned from, at most; chosen by a
#: hash of the id. The others are weighed by how many they stand for.
TRAINING_TOXIC, TRAINING_OTHER = 3_000, 5_000
#: Stems kept at most, and the documents a stem must occur in.
LEXICON_TERMS, LEAST_DOCS = 400, 4
#: Stem lengths tried, and the least length at which one edit is allowed.
SHORTEST, LONGEST, FUZZY_FROM = 3, 12, 5
#: What a misspelt or quoting variant of a training text counts against the text itself.
VARIANT_WEIGHT = 0.2
#: Words on each side of a match that are its context.
WINDOW = 6
#: Words that announce talk about a term rather than its use.
MENTION = {"word", "words", "term", "called", "said", "says", "quote", "quoted", "quotes", "wrote", "writes", "insult", "slur", "mot", "wort", "palabra"}
FEATURES = ["bias", "exact", "fuzzy", "quoted", "dense", "best"]
_word = re.compile(r"[\w@$*]+")
NOTHING = (0.0, 0.0)
_OPEN, _CLOSE = "\"'([{“‘«„‹", "\"')]}”’»“›"


class Model(NamedTuple):
    terms: dict[str, float]
    weights: list[float]


class Trie:
    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in sorted(terms):
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = t


class Lexicon:
    """Tries of all stems and of those long enough to be misspelt; words are matched against both."""

    def __init__(self, terms: dict[str, float]):
        self.weight = terms
        self.exact = Trie(terms)
        loose = [t for t in terms if len(t) >= FUZZY_FROM]
        self.loose = Trie(loose)
        # an edit in the first two letters leaves the next three, which move by one place at most
        self.inner = {t[2:5] for t in loose}
        self.memo = WordCache(lambda w: self.look(w.strip("_@$*")), 300_000)

    def match(self, word: str) -> tuple[float, float]:
        """Largest weight of a stem that ``word`` begins with, and of one that it is but for one edit."""
        return self._match(word, False)

    def look(self, word: str) -> tuple[float, float]:
        """As :meth:`match`, but a misspelt stem may also have an ending; its edit is then followed by a letter that agrees."""
        return self._match(word, True)

    def _match(self, word: str, endings: bool) -> tuple[float, float]:
        exact = fuzzy = 0.0
        node = 0
        for c in word:
            node = self.exact.children[node].get(c, -1)
            if node < 0:
                break
            t = self.exact.term[node]
            if t is not None:
                exact = max(exact, self.weight[t])
        if not exact and len(word) >= FUZZY_FROM:
            for t in self._near(word, endings):
                fuzzy = max(fuzzy, self.weight[t])
        return exact, fuzzy

    def _near(self, word: str, endings: bool):
        """Stems within one edit of ``word``, or of its beginning: states of the edit-distance automaton are (trie node,
        letters read, edits, whether a letter agreed behind the edit)."""
        children, term = self.loose.children, self.loose.term
        if not self.inner.isdisjoint((word[1:4], word[2:5], word[3:6])):
            todo = [(0, 0, 0, False)]
        else:  # no edit in the first two letters
            node = children[children[0].get(word[0], 0)].get(word[1], 0) if word[0] in children[0] else 0
            todo = [(node, 2, 0, False)] if node else []
        n = len(word)
        while todo:
            node, at, used, firm = todo.pop()
            if term[node] is not None and (n - at + used <= 1 or (endings and firm)):
                yield term[node]
            nxt = children[node].get(word[at], -1) if at < n else -1
            if nxt >= 0:
                todo.append((nxt, at + 1, used, used > 0))
            if not used:
                # one more letter in the word, one fewer, or another one; then the rest must agree
                if at < n:
                    todo.append((node, at + 1, 1, False))
                for child in children[node].values():
                    todo.append((child, at, 1, False))
                    if child != nxt and at < n:
                        todo.append((child, at + 1, 1, False))

    def features(self, text: str) -> list[float]:
        """Sums over the matches of a text, in the order of FEATURES."""
        lower = text.lower()
        different = list(set(_word.findall(lower)))
        telling = {w: ef for w, ef in zip(different, self.memo.all(different), strict=True) if ef != NOTHING}
        if not telling:
            return [1.0, 0, 0, 0, 0, 0]
        # lower-casing can change the length of a text; then its places are those of the lower-cased text
        text = text if len(text) == len(lower) else lower
        found = list(_word.finditer(lower))
        words = [m.group() for m in found]
        hits = [(i, *telling[w]) for i, w in enumerate(words) if w in telling]
        exact = fuzzy = quoted = dense = best = 0.0
        for k, (i, e, f) in enumerate(hits):
            m = found[i]
            before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
            marked = bool(before) and before in _OPEN and bool(after) and after in _CLOSE
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            if marked or any(w in MENTION for w in near):
                quoted += e + f
                continue
            exact += e
            fuzzy += f
            best = max(best, e)
            dense += sum(1.0 for j in (k - 1, k + 1) if 0 <= j < len(hits) and abs(hits[j][0] - i) <= 4 * WINDOW)
        rate = 200.0 / max(200.0, len(words))
        return [1.0, math.log1p(exact) + 2 * math.log1p(exact * rate), math.log1p(fuzzy), math.log1p(quoted), math.log1p(dense * rate), best]

    def misspelt(self, text: str) -> str:
        """``text`` with a letter left out of every word that is matched exactly."""

        def changed(m: re.Match) -> str:
            w = m.group()
            return w[:2] + w[3:] if len(w) > FUZZY_FROM and self.match(w.lower())[0] else w

        return _word.sub(changed, text)

    def mentioning(self, text: str) -> str:
        """``text`` and sentences that quote two of the most telling stems."""
        best = sorted(self.weight, key=lambda t: (-self.weight[t], t))[:20]
        if not best:
            return text
        at = len(text) % len(best)
        return f'{text}\nThe word "{best[at]}" and "{best[-1 - at]}".'

    def score(self, text: str, weights: list[float]) -> float:
        z = sum(a * b for a, b in zip(self.features(text), weights, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _stems(training: DataFrame) -> list:
    """Per stem: toxic and other documents, with the totals; only stems that can enter the lexicon."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= SHORTEST))
    stems = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST))), lambda n: F.substring(w, F.lit(1), n))))
    toxic = training.where("toxic = 1").select(F.explode(F.array_distinct(stems)).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("bad"))
    toxic = pinned(toxic.where(F.col("bad") >= LEAST_DOCS))
    # other documents are counted for the stems of toxic ones only; those are bounded by TRAINING_TOXIC
    clean = training.where("toxic = 0").select(F.explode(F.array_distinct(stems)).alias("stem")).join(toxic.select("stem"), "stem", "left_semi")
    clean = clean.groupBy("stem").agg(F.count(F.lit(1)).alias("fine"))
    both = toxic.join(clean, "stem", "left").na.fill(0, ["fine"])
    n = training.agg(F.sum(F.col("toxic")).alias("bad"), F.sum(1 - F.col("toxic")).alias("fine")).first()
    bad, fine = n["bad"] or 0, n["fine"] or 0
    gain = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("fine") + 0.5) / (fine + 1.0))
    best = both.withColumn("gain", gain).where(F.col("gain") > 1.5)
    # a stem is worth its share of toxic documents; of a stem and a longer form of it, the clearer one serves
    return best.orderBy(F.desc(F.col("gain") * F.log1p(F.col("bad"))), "stem").limit(20 * LEXICON_TERMS).collect()


def choose_terms(rows: list) -> dict[str, float]:
    """Stems by worth, leaving out forms that a chosen stem already covers or that only blur one."""
    terms: dict[str, float] = {}
    support: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (-r["gain"] * math.log1p(r["bad"]), -len(r["stem"]), r["stem"])):
        stem, gain, bad = r["stem"], r["gain"], r["bad"]
        if len(terms) >= LEXICON_TERMS:
            break
        shorter = [t for t in terms if stem.startswith(t)]
        if any(terms[t] >= gain - 0.7 for t in shorter):
            continue
        if any(t.startswith(stem) and support[t] >= 0.8 * bad for t in terms):
            continue
        terms[stem], support[stem] = gain, bad
    return terms


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> list[float]:
    """Logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and weights from labelled rows whose crc32 of the id is not 0 modulo 5, up to a bound of each kind.

    Without labels of both kinds the model has no terms and scores everything 0.
    """
    prepare(docs.sparkSession)
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("toxic = 1").orderBy(*order).limit(TRAINING_TOXIC).unionByName(marks.where("toxic = 0").orderBy(*order).limit(TRAINING_OTHER))
    marks = pinned(chosen)
    texts = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    training = pinned(texts.join(F.broadcast(marks), "doc_id").repartition("doc_id"))
    terms = choose_terms(_stems(training))

    # toxic texts are learned from as they are and misspelt, the others as they are and with quotations
    def features(toxic: int):
        def worker():
            lexicon = Lexicon(terms)
            variant = lexicon.misspelt if toxic else lexicon.mentioning
            return lambda texts: (None, [[lexicon.features(f(t)) for t in texts] for f in (str, variant)])

        own = map_texts(training.where(F.col("toxic") == toxic), "doc_id", "text", "x array<double>, y array<double>", worker)
        return own.select("doc_id", F.lit(toxic).alias("toxic"), F.posexplode(F.array("x", "y")).alias("variant", "x"))

    rows = sorted(features(0).unionByName(features(1)).collect(), key=lambda r: (r["doc_id"], r["toxic"], r["variant"]))
    y = np.array([r["toxic"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model({}, [-30.0] + [0.0] * (len(FEATURES) - 1))
    taken = {0: min(n[0], TRAINING_OTHER), 1: min(n[1], TRAINING_TOXIC)}
    weight = np.array([(VARIANT_WEIGHT if r["variant"] else 1.0) * n[r["toxic"]] / taken[r["toxic"]] for r in rows])
    return Model(terms, fit(np.array([r["x"] for r in rows]), y, weight))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    A null text counts as empty; empty texts get the score of a text without a match. A null id is
    never held out. Repeated rows are each scored; an empty table gives an empty result. Columns other
    than id and text are not looked at.
    """

    def worker():
        lexicon = Lexicon(model.terms)
        return lambda texts: (None, [[lexicon.score(t, model.weights) for t in texts]])

    scored = map_texts(docs, id_col, text_col, "score double", worker)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``at`` or more; all columns stay.

    A null text counts as empty, and an empty one scores as a text without a match, so both stay as a
    rule. Rows that repeat a text or an id are judged alike. Without labels of both kinds, or without
    rows, nothing goes.
    """
    model = train(docs, labels, id_col, text_col)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.terms)
        for texts in batches:
            yield texts.map(lambda t: lexicon.score(t, model.weights))

    return docs.where(score(text_of(docs, text_col)) < at)
