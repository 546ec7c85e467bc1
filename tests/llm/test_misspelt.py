"""Misspelt stems of any weight, with and without an ending, against brute force."""

import random

from siftwell.llm.toxicity import Lexicon

TERMS = {"idiot": 6.0, "moron": 2.0, "worthless": 1.6, "scumbag": 3.0, "bad": 5.0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _misspelt(word, term):
    """Whole word within one edit, or a beginning within one edit that lies before the last letter of the term."""
    if distance(word, term) <= 1:
        return True
    for at in range(len(term)):
        head, rest = term[:at], term[at:]
        if not word.startswith(head):
            return False
        more = word[at:]
        if more[1:].startswith(rest) or (len(rest) > 1 and (more.startswith(rest[1:]) or more[1:].startswith(rest[1:]))):
            return True
    return False


def test_stems_of_any_weight_and_with_endings():
    lexicon, rng = Lexicon(TERMS), random.Random(4)
    for _ in range(5000):
        word = list(rng.choice(list(TERMS)) + rng.choice(["", "s", "ing", "xx"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "i", "o"])
        word = "".join(word)
        exact, fuzzy = lexicon.look(word)
        near = [w for t, w in TERMS.items() if len(t) >= 5 and len(word) >= 5 and _misspelt(word, t)]
        assert bool(exact) == any(word.startswith(t) for t in TERMS)
        assert fuzzy == (0.0 if exact else max(near, default=0.0)), word
    assert lexicon.look("idi0ts")[1] == 6.0 and lexicon.look("mor0n")[1] == 2.0
    assert lexicon.look("idiosyncrasy") == lexicon.look("morocco") == (0.0, 0.0)
    assert lexicon.features("those idi0ts")[2] > 0 and lexicon.features("what a wrthless thing")[2] > 0
