"""Language identification against the same model over plain string n-grams, and ambiguity of mixed texts."""

import math
import random
from collections import Counter
from functools import cache

import pytest

from ledgerweave.llm import language_id as L

ALPHABETS = {"aa": "abcde", "bb": "cdefg", "cc": "fghij", "dd": "aeiou", "ee": "jklmn"}
SHAPE = "doc_id int, text string, lang string"


def some_text(rng, lang, words):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(words))


def plain_grams(text):
    out, run = [" "], False
    for c in text.lower():
        if c.isalpha():
            out.append(c)
            run = False
        elif not run:
            out.append(" ")
            run = True
    line = "".join(out) + " "
    return Counter(line[i : i + n] for n in L.ORDERS for i in range(len(line) - n + 1))


def plain_model(train):
    langs = sorted({lang for _, _, lang in train})
    counts = {x: Counter() for x in langs}
    for _, text, lang in train:
        counts[lang] += plain_grams(text)
    buckets = 1 << L.BUCKETS_LOG2
    share = lambda x, g: (counts[x][g] + L.SMOOTH) / (sum(counts[x].values()) + L.SMOOTH * buckets)
    words = {x: list(row) for x, row in zip(langs, L.codewords(len(langs)), strict=True)}
    bits = [b for b in range(len(words[langs[0]])) if len({words[x][b] for x in langs}) > 1]

    @cache
    def weight(b, g):
        mean = lambda side: sum(share(x, g) for x in side) / len(side)
        return math.log(mean([x for x in langs if words[x][b] > 0]) / mean([x for x in langs if words[x][b] < 0]))

    every = set().union(*counts.values())

    def trust(x):
        rest = share(x, None) * (buckets - len(every))  # buckets that no n-gram has
        parts = [max(words[x][b] * (sum(share(x, g) * weight(b, g) for g in every) + rest * weight(b, None)), 0) + 1e-9 for b in bits]
        return [p / sum(parts) for p in parts]

    trusts = {x: trust(x) for x in langs}

    def predict(text):
        found = plain_grams(text)
        margin = [sum(n * weight(b, g) for g, n in found.items()) / sum(found.values()) for b in bits]
        loss = {x: sum(t * math.log1p(math.exp(-L.SHARPNESS * words[x][b] * m)) for t, b, m in zip(trusts[x], bits, margin, strict=True)) for x in langs}
        best = min(loss, key=loss.get)
        return best, 1 / sum(math.exp(-L.CERTAINTY * (v - loss[best])) for v in loss.values()), sorted(loss.values())

    return predict


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(4)
    train = [(i, some_text(rng, lang, 30), lang) for i, lang in enumerate([*ALPHABETS] * 4)]
    return rng, train, L.fit(spark.createDataFrame(train, SHAPE).repartition(3))


def test_same_as_plain_ngrams(spark, fitted):
    """Hashing lets a few n-grams share a bucket, so scores may differ slightly."""
    rng, train, codes = fitted
    fresh = [(i, some_text(rng, lang, rng.randint(1, 12)).upper() + rng.choice(["", "!? 12", " "]), lang) for i, lang in enumerate([*ALPHABETS] * 6)]
    want = plain_model(train)
    right = 0
    for row in L.predict(spark.createDataFrame(fresh, SHAPE), codes).collect():
        lang, score, losses = want(row["text"])
        if losses[1] - losses[0] > 0.01:
            assert row["lang_pred"] == lang
        assert row["score"] == pytest.approx(score, abs=0.05)
        right += row["lang_pred"] == row["lang"]
    assert right >= 24


def test_ambiguity(spark, fitted):
    """A text is ambiguous just when its two nearest codewords are nearly as close."""
    rng, train, codes = fitted
    one, other = some_text(rng, "aa", 2000).split(), some_text(rng, "dd", 2000).split()
    # From one language to the other, in small steps where the two codewords change places.
    mixes = [(i, " ".join(one[:i] + other[i:]), None) for i in (0, *range(850, 1150, 2), 2000)]
    want = plain_model(train)
    got = sorted(L.predict(spark.createDataFrame(mixes, SHAPE), codes).collect(), key=lambda r: r["doc_id"])
    assert not got[0]["ambiguous"] and not got[-1]["ambiguous"]
    assert (got[0]["lang_pred"], got[-1]["lang_pred"]) == ("dd", "aa")
    for row in got:
        gap = want(row["text"])[2]
        gap = gap[1] - gap[0]
        if abs(gap - L.AMBIGUOUS) > 0.01:
            assert row["ambiguous"] == (gap < L.AMBIGUOUS)
    assert any(r["ambiguous"] for r in got)
