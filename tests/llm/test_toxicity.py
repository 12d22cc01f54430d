"""Toxicity scores against a plain version: folding, counts, matching and the curve."""

import collections
import math
import random
import time
import unicodedata

import pytest

from panelwise.llm import toxicity

TEXTS = ["you idiot of words", "grobian! go away grobian", "the trash can is full", "a day of clean words", "grobschmied at work", ""]


def plain_fold(text):
    out = []
    taken = unicodedata.normalize("NFKD", text)
    for i, c in enumerate(taken):
        inner = 0 < i < len(taken) - 1 and all(x.isalnum() or x == "_" for x in (taken[i - 1], taken[i + 1]))
        if c in "!|" and inner:
            out.append("i")
        elif unicodedata.category(c) not in ("Mn", "Me", "Cf"):
            c = c.lower()
            c = toxicity.LOOK_ALIKES.get(c, toxicity.SIGNS.get(c, c))[0]
            out.append(c if c.isalpha() else " ")
    return f" {''.join(out)} "


def plain_features(folded):
    found = collections.Counter()
    for w in folded.split():
        found[""] += 1
        if len(w) <= toxicity.LONGEST_ENTRY:
            found[f" {w} "] += 1
        for size in range(toxicity.LEAST_PREFIX, min(len(w), toxicity.LONGEST_ENTRY) + 1):
            found[f" {w[:size]}"] += 1
    return found


def plain_total(text, weights, exceptions):
    """Strongest entry at each place where a word begins, without the places inside an exception."""
    folded = plain_fold(text)
    spared = set()
    for e in exceptions:
        e = plain_fold(e).rstrip(" ") + " "
        at = folded.find(e)
        while at >= 0:
            spared.update(range(at, at + len(e) - 1))
            at = folded.find(e, at + 1)
    total = 0.0
    for place in range(len(folded)):
        here = [w for entry, w in weights if folded.startswith(entry, place)]
        if here and place not in spared:
            total += max(here)
    return total, len(folded.split())


@pytest.mark.parametrize("written", ["idiot", "IDIOT", "1d10t", "id!ot", "id|ot", "i​diot", "id­iot", "idïot", "idïot", "ｉｄｉｏｔ", "іdіоt", "ĭđiot".replace("đ", "d"), "𝐢𝐝𝐢𝐨𝐭"])
def test_written_forms_fold_alike(written):
    assert toxicity.fold(f"you {written}!") == " you idiot  "


def test_folding_equals_plain_version():
    r = random.Random(2)
    letters = "abIé!|0154@$ ﬁœß́​­Дабα日本 \n,x"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert toxicity.fold(text) == plain_fold(text), repr(text)


def test_features_equal_plain_counts():
    r = random.Random(4)
    for _ in range(500):
        folded = toxicity.fold(" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 40))))
        found = list(toxicity.features(folded))
        assert len(found) == len({f for f, _ in found})
        assert {f: n for f, n in found if n} == dict(plain_features(folded))


def test_matching_equals_plain_version():
    r = random.Random(7)
    weights = ((" idiot ", 3.0), (" idi", 2.5), (" grob", 2.1), (" trash", 2.2), (" b c", 4.0))
    exceptions = ("grobschmied", "trash can", "b idiot")
    lexicon = toxicity.Lexicon(weights, exceptions, (-2.0, 1.0, 0.5))
    words = ["idiot", "idioms", "grobian", "grobschmied", "trash", "can", "a", "b", "c", "İdiot", "tr@sh"]
    for _ in range(2000):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 30)))
        total, n = toxicity.matched(toxicity.fold(text), lexicon.automaton())
        want = plain_total(text, weights, exceptions)
        assert (pytest.approx(total), n) == want, text
        z = -2 + math.log(1 + total) + 0.5 * math.log(1 + 100 * total / max(n, 1))
        assert toxicity._score(lexicon.curve, total, n) == pytest.approx(1 / (1 + math.exp(-z)))


def test_learned_lexicon_equals_plain_counts(spark):
    """Weights, exceptions and scores of a small corpus, worked out by hand from plain counts."""
    r = random.Random(9)
    toxic = [f"{r.choice(['grobian', 'grobiane'])} you {r.choice('xyz')}" for _ in range(100)]
    clean = [f"the {'grobschmied' if i % 10 == 0 else r.choice(['smith', 'day'])} of {r.choice('xyz')}" for i in range(100)]
    texts = toxic + clean
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(200)], "doc_id bigint, toxic int")
    lexicon = toxicity.train(docs, labels)
    kept = {r.doc_id: r for r in toxicity.training_rows(docs, labels).collect()}
    counts = {0: collections.Counter(), 1: collections.Counter()}
    for row in kept.values():
        counts[row.toxic] += plain_features(plain_fold(row.text))
    for entry, weight in lexicon.weights:
        t, c = counts[1][entry], counts[0][entry]
        want = math.log((t + 0.5) / (counts[1][""] + 1)) - math.log((c + 0.5) / (counts[0][""] + 1))
        assert weight == pytest.approx(want, abs=1e-6) and want >= toxicity.LEAST_LOG_RATIO
    assert lexicon.exceptions == ("grobschmied",) and lexicon.weights
    for row in toxicity.score(docs, lexicon).collect():
        total, n = plain_total(texts[row.doc_id], lexicon.weights, lexicon.exceptions)
        assert row.score == pytest.approx(toxicity._score(lexicon.curve, total, n))
        assert row.predicted == int(row.score >= 0.5)


def test_long_texts_take_linear_time():
    lexicon = toxicity.Lexicon(((" idiot ", 3.0), (" grob", 2.1)), ("grobschmied",), (-2.0, 1.0, 0.5))
    automaton = lexicon.automaton()
    for text in ("grobschmied idiot " * 60_000, "idi​ot " * 120_000, "!" * 10**6, "grobschmied" * 90_000):
        begun = time.perf_counter()
        toxicity.matched(toxicity.fold(text), automaton)
        sum(1 for _ in toxicity.features(toxicity.fold(text)))
        assert time.perf_counter() - begun < 10
