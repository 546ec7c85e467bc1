"""Scores and rules against brute force or held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwell.llm.common import pinned
from siftwell.llm.lm_scoring import BYTE_LEAD, BYTE_TABLES, END, GATES, STEPS, TURN_LEAD, TURN_TABLES, Mixer, Tree, byte_decisions, lm_scores, words_of
from siftwell.llm.quality import measures, quality_rules
from siftwell.llm.toxicity import Lexicon, fit, toxicity, train

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measures(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(docs):
    texts = Counter((r.doc_id, slow_measures(r.text or "")) for r in docs.collect())
    got = Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in measures(docs).collect())
    assert got == texts


def test_rules_keep_good_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules(docs).join(labels, "doc_id").collect()
    sound = [r for r in rows if not r.base_failed]
    assert all(not r.kept for r in rows if r.base_failed)
    assert np.mean([r.kept for r in sound if r.quality == 1]) > 0.98 and np.mean([r.kept for r in sound if r.quality == 0]) < 0.1


def slow_quantile(values, q):
    """The least value whose share of values up to it reaches q."""
    values = sorted(values)
    return values[min(len(values) - 1, max(0, math.ceil(q * len(values) - 1e-9) - 1))]


def test_fences_against_exact_quantiles(spark):
    """Fences and verdicts of every group, with exact quantiles in place of sketches."""
    import siftwell.llm.quality as quality

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    groups, rows = {}, {}
    for d in docs:
        words, chars, symbols, dups, repeats = slow_measures(d.text or "")
        lines = len([x for x in (d.text or "").split("\n") if WORD.search(x)])
        rows[d.doc_id] = (d.lang, d.source), words < 50 or 100 * repeats > 50 * words, {"chars_per_word": chars / max(words, 1), "symbols_per_word": symbols / max(words, 1), "dup_line_share": dups / max(lines, 1), "repeat_share": repeats / max(words, 1), "n_words": words, "n_lines": lines}
        if not rows[d.doc_id][1]:
            groups.setdefault((d.lang, d.source), []).append(rows[d.doc_id][2])
    every = [x for g in groups.values() for x in g]
    fences = {}
    for g, own in groups.items():
        q = lambda c, p, own=own: (len(own) * slow_quantile([x[c] for x in own], p) + quality.PRIOR * slow_quantile([x[c] for x in every], p)) / (len(own) + quality.PRIOR)
        for r, (high, unit, two_sided) in quality.RATIOS.items():
            middle, step = q(r, 0.5), 1 / q(unit, 0.5)
            fences[g, r] = middle - quality.REACH * max(middle - q(r, 1 - high), step) if two_sided else -math.inf, middle + quality.REACH * max(q(r, high) - middle, step)
    measured = pinned(measures(spark.read.parquet(f"{SF}/documents.parquet")))
    failed = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
    for f in quality.fences(measured.selectExpr("*", f"{failed} as base_failed")).collect():
        for r in quality.RATIOS:
            assert (f[f"{r}_min"], f[f"{r}_max"]) == pytest.approx(fences[(f.lang, f.source), r], rel=0.02, abs=1e-3)
    assert all(len({round(fences[g, r][1], 9) for g in groups}) > 5 for r in quality.RATIOS)  # every ratio adapts
    got = {r.doc_id: r.kept for r in quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want = {i: not bad and all(fences[g, r][0] <= x[r] <= fences[g, r][1] for r in quality.RATIOS) for i, (g, bad, x) in rows.items()}
    assert sum(got[i] != want[i] for i in want) <= 0.005 * len(want)  # sketches of all documents are not exact


def test_salted_join_gives_the_same(docs, monkeypatch):
    import siftwell.llm.quality as quality

    before = sorted(map(str, quality.quality_rules(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(map(str, quality.quality_rules(docs).collect())) == before


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton():
    terms = ["idiot", "moron", "worthless", "scumbag"]
    lexicon, rng = Lexicon(dict.fromkeys(terms, 5.0)), random.Random(2)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "i", "o"])
        word = "".join(word)
        exact, fuzzy = lexicon.match(word)
        assert bool(exact) == any(word.startswith(t) for t in terms)
        assert bool(exact or fuzzy) == (bool(exact) or (len(word) >= 5 and any(slow_distance(word, t) <= 1 for t in terms)))


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels)
    rows = toxicity(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.94
    lexicon = Lexicon(model.terms)
    abuse, quote = lexicon.score("You idiot, you stupid clown.", model.weights), lexicon.score('The word "idiot" is an insult.', model.weights)
    assert abuse > 0.5 > quote and lexicon.score("You idi0t, you stupd clown.", model.weights) > 0.5


def test_fit_separates():
    x = np.array([[1.0, 0], [1, 1], [1, 2], [1, 3]])
    w = fit(x, np.array([0.0, 0, 1, 1]), np.ones(4))
    assert ((x @ w > 0) == [False, False, True, True]).all()


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.select("doc_id", "text").collect(), {r.doc_id: r for r in lm_scores(docs).collect()}


def test_base_scores(scored):
    docs, rows = scored
    train = Counter()
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 5 != 1:
            train.update([*words_of(d.text), END])
    n, v = sum(train.values()), len(train)
    for d in docs:
        tokens, r = [*words_of(d.text), END], rows[d.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))


def test_model_scores(scored):
    """Better than the base made a distribution: all unknown words share its half count, and are spelt in 27 letters."""
    docs, rows = scored
    known = Counter()
    for d in docs:
        if not rows[d.doc_id].held_out:
            known.update(words_of(d.text))
    held = [d for d in docs if rows[d.doc_id].held_out]
    spelt = sum((len(w) + 1) * math.log10(27) for d in held for w in words_of(d.text) if not known[w])
    score, base = (sum(getattr(rows[d.doc_id], c) for d in held) for c in ("score", "base_score"))
    assert base - spelt < score < 0 and all(rows[d.doc_id].score < 0 for d in docs)
    assert np.mean([rows[d.doc_id].bits_per_byte for d in held]) < 2.5


def test_model_beats_the_base_on_more_text(spark):
    rows = lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = ({r.doc_id: r.score for r in lm_scores(docs.repartition(n)).collect()} for n in (2, 7))
    assert all(one[i] == pytest.approx(two[i], rel=1e-9) for i in one)


def random_mixer(tables, lead, bits=14):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (tables, 1 << bits, 2)).astype(np.uint16)
    return Mixer(counts, lead, rng.normal(0.3, 0.1, GATES * tables * GATES), rng.integers(0, 9, (STEPS * 8, 2)))


def spell(mixer, words):
    out = np.zeros(len(words))
    for d in byte_decisions(words, 14):
        out[d.owner] += mixer.logs(d)
    return out / math.log(10)


def test_bytes_are_a_distribution():
    mixer = random_mixer(BYTE_TABLES, BYTE_LEAD)
    prefix = spell(mixer, [b"ab"])[0]
    assert sum(10 ** (x - prefix) for x in spell(mixer, [b"ab" + bytes([c]) for c in range(256)])) == pytest.approx(1, abs=1e-4)
    d = next(byte_decisions([b"ab", b"c"], 14))
    assert len(d.slots) == BYTE_TABLES and "".join(map(str, d.bits.astype(int)))[:8] == f"{ord('a'):08b}" and d.first.tolist() == [0, 16] and d.owner.tolist() == [0, 1]


def test_turns_are_a_distribution():
    """In any context the leaves, escape and end mark among them, have probabilities that sum to one."""
    counts = {b"w%d" % i: 1 + 100 // (i + 1) for i in range(50)} | {END: 9}
    tree, mixer = Tree(counts, 1000), random_mixer(TURN_TABLES, TURN_LEAD)
    ids, endings, first, unlisted = tree.ids_of(["w1 w3 unheard w2 w1"])
    assert unlisted == [b"unheard"] and len(ids) == 6 and ids[2] == tree.escape
    contexts = tree.contexts(ids, endings, first)
    for place in range(len(ids)):
        leaves = np.arange(len(tree.sizes))
        logs = np.concatenate([mixer.logs(d) for d in tree.turns([np.repeat(c[place : place + 1], len(leaves)) for c in contexts], leaves, 14)])
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_contexts_reach_back_in_their_text_only():
    tree = Tree({b"a": 9, b"b": 8, b"c": 7, END: 5}, 40)
    whole = tree.contexts(*tree.ids_of(["a b c a", "c b"])[:3])
    alone = tree.contexts(*tree.ids_of(["c b"])[:3])
    assert all((x[5:] == y).all() for x, y in zip(whole, alone, strict=True))
    other = tree.contexts(*tree.ids_of(["b b c a"])[:3])
    assert all(len({int(x[2]), int(y[2])}) == 2 for x, y in zip(whole[2:4], other[2:4], strict=True))  # two words back
