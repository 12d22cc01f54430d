"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding takes characters apart (compatibility forms, accents), drops marks and
invisible format characters, lower-cases, maps look-alike letters of other scripts
and digits or signs used as letters (`!` and `|` inside a word only) and turns
everything else into blanks. The lexicon is learned: words, and beginnings of words, that make up far more of the
words of labelled toxic documents than of others, weighted by that log ratio. Exception phrases
(given, or words learned to be harmless although they begin like an entry) cancel
the matches they cover. A document's matches are summed, once as they are and
once by its length, and a logistic curve fitted to the same labelled rows turns
both into a score from 0 to 1.

Null texts count as empty; a text without matches gets the score of the curve at
0. Labels without document or class are left out, repeated labels of a document
count once (as toxic if any says so), repeated documents count as often as they
stand there. Without any labelled row all scores are the prior of an empty sample
(about 0.09), so nothing is rejected. Extra columns are not read, or carried along untouched by
`keep_clean`. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import bounded, col, slices, strings

TRAINING_ROWS = 12_000
LEXICON_ENTRIES = 4_000
LEAST_PREFIX = 4
LONGEST_ENTRY = 24
LEAST_DOCUMENTS = 5
LEAST_LOG_RATIO = 2.0
FOLDS = 5
COUNTED_AT_ONCE = 100_000

# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_STROKES = re.compile(r"(?<=\w)[!|](?=\w)")


class _Folding(dict):
    """Translation table of characters taken apart, which works out a character when it first meets it."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):
            self[code] = ""
            return ""
        low = c.lower()
        low = LOOK_ALIKES.get(low, SIGNS.get(low, low))[0]
        self[code] = out = low if low.isalpha() else " "
        return out


_FOLD = _Folding()


def fold(text: str) -> str:
    """Folded text, with a blank before and after."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if "!" in text or "|" in text:
        text = _STROKES.sub("i", text)
    return f" {text.translate(_FOLD)} "


def features(folded: str) -> Iterator[tuple[str, int]]:
    """What a document shows of a lexicon, each once with its count: ' word ', the beginnings ' wor' of its words; '' counts words.

    In sorted order the words that share a beginning stand together, so only the
    beginnings of one word are open at a time.
    """
    words = Counter(folded.split())
    yield "", sum(words.values())
    open_word, counts = "", [0] * (LONGEST_ENTRY + 1)
    for w in [*sorted(words), ""]:
        shared = 0
        for x, y in zip(open_word, w):
            if x != y:
                break
            shared += 1
        for size in range(max(shared + 1, LEAST_PREFIX), min(len(open_word), LONGEST_ENTRY) + 1):
            yield f" {open_word[:size]}", counts[size]
            counts[size] = 0
        n = words.get(w, 0)
        for size in range(LEAST_PREFIX, min(len(w), LONGEST_ENTRY) + 1):
            counts[size] += n
        if n and len(w) <= LONGEST_ENTRY:
            yield f" {w} ", n
        open_word = w


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, exceptions, and the curve (intercept, weight of the sum, weight of the sum by length)."""

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton | None:
        both = {fold(e).rstrip(" ") + " ": 0.0 for e in self.exceptions} | dict(self.weights)
        if not both:
            return None
        made = ahocorasick.Automaton()
        for entry, weight in both.items():
            made.add_word(entry, (len(entry), weight))
        made.make_automaton()
        return made


def matched(folded: str, automaton: ahocorasick.Automaton | None) -> tuple[float, int]:
    """Sum of the weights at the word places that match (the strongest entry each), and the number of words."""
    words = folded.count(" ") and len(folded.split())
    if automaton is None:
        return 0.0, words
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        begin = end - size + 1
        if weight:
            best[begin] = max(best.get(begin, 0.0), weight)
        else:
            spared.append((begin, end))
    if not spared:
        return sum(best.values()), words
    spared.sort()
    total, covered, i = 0.0, -1, 0
    for place in sorted(best):
        while i < len(spared) and spared[i][0] <= place:
            covered = max(covered, spared[i][1])
            i += 1
        if place >= covered:
            total += best[place]
    return total, words


def measures(total: float, words: int) -> tuple[float, float]:
    """What the curve looks at: the sum of weights, and the sum by length, both damped."""
    return math.log1p(total), math.log1p(100 * total / max(words, 1))


def _score(curve: tuple[float, float, float], total: float, words: int) -> float:
    a, b = measures(total, words)
    z = curve[0] + curve[1] * a + curve[2] * b
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id: Column) -> Column:
    """Whether the documents' fold is the one that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, toxic, text of at most `most` labelled documents outside the held-out fold, picked by a hash of their id."""
    known = bounded(labels).select(col("doc_id").alias("doc_id"), col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(col("doc_id").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    # at most `most` pairs of ids and classes
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By feature, how often it stands in each class and in how many toxic documents, summed up within the task."""
    sums: dict[str, list[int]] = {}

    def out():
        columns = zip(*sums.values())
        return pa.RecordBatch.from_arrays([pa.array(list(sums)), *(pa.array(c, pa.int64()) for c in columns)], names=["f", "clean", "toxic", "docs"])

    for part in _parts(batches):
        for toxic, text in zip(part.column("toxic").to_pylist(), strings(part.column("text")).to_pylist()):
            toxic = min(toxic, 1)
            for f, n in features(fold(text)):
                row = sums.setdefault(f, [0, 0, 0])
                row[toxic] += n
                row[2] += toxic
                if len(sums) > COUNTED_AT_ONCE:
                    yield out()
                    sums = {}
    if sums:
        yield out()


def _begins_like(word: str, entries: Iterable[str]) -> bool:
    """Whether ' word ' begins with an entry."""
    return any(word[:n] in entries for n in range(LEAST_PREFIX + 1, len(word)))


def _words_like(entries: set[str]):
    """How often the words that begin like an entry stand in each class, summed up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for part in _parts(batches):
            for toxic, text in zip(part.column("toxic").to_pylist(), strings(part.column("text")).to_pylist()):
                for w, n in Counter(fold(text).split()).items():
                    if _begins_like(f" {w} ", entries):
                        sums.setdefault(w, [0, 0])[min(toxic, 1)] += n
        columns = list(zip(*sums.values())) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["f", "clean", "toxic"])

    return run


def choose(counts: Iterable[tuple[str, int, int, int]]) -> tuple[dict[str, float], list[str]]:
    """Entries with their weights, and learned exceptions, from counts by feature."""
    rows = {f: (c, t, n) for f, c, t, n in counts}
    clean, toxic, _ = rows.pop("", (0, 0, 0))

    def ratio(c: int, t: int) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    kept = {f: ratio(c, t) for f, (c, t, n) in rows.items() if n >= LEAST_DOCUMENTS and ratio(c, t) >= LEAST_LOG_RATIO}
    # a beginning says no more than a longer entry that stands at the same places
    longer: set[tuple[str, tuple[int, int, int]]] = set()
    for f in kept:
        short = f.rstrip(" ")
        longer.update((short[:n], rows[f]) for n in range(LEAST_PREFIX + 1, len(short) + f.endswith(" ")))
    kept = {f: w for f, w in kept.items() if (f, rows[f]) not in longer}
    strongest = sorted(kept, key=lambda f: (-kept[f] * math.sqrt(rows[f][2]), f))[:LEXICON_ENTRIES]
    entries = {f: round(kept[f], 6) for f in strongest}
    harmless = [
        f.strip()
        for f, (c, t, _) in rows.items()
        if f.endswith(" ") and c >= LEAST_DOCUMENTS and ratio(c, t) <= 0 and _begins_like(f, entries)
    ]
    return entries, sorted(harmless)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression of the class on the two measures, by Newton's method."""
    if not len(y):
        return -math.log(10), 0.0, 0.0
    a = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(3)
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 9) for v in w)


def train(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = (), most: int = TRAINING_ROWS) -> Lexicon:
    """Lexicon and curve from the bounded sample of labelled rows."""
    rows = training_rows(docs, labels, most)
    counted = rows.select("toxic", "text").mapInArrow(_counts, "f string, clean bigint, toxic bigint, docs bigint")
    sums = counted.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "docs")])
    # bounded by the sample: features that enough of its toxic documents hold
    counts = [tuple(r) for r in sums.where((F.col("docs") >= LEAST_DOCUMENTS) | (F.col("f") == "")).collect()]
    entries, harmless = choose(counts)
    if entries:  # words of clean documents alone are not among the counts; bounded by the sample too
        like = rows.select("toxic", "text").mapInArrow(_words_like(set(entries)), "f string, clean bigint, toxic bigint")
        like = like.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic")]).where(F.col("clean") >= LEAST_DOCUMENTS)
        total = next(r for r in counts if r[0] == "")
        harmless += [r.f for r in like.collect() if (r.toxic + 0.5) * (total[1] + 1) <= (r.clean + 0.5) * (total[2] + 1)]
    lexicon = Lexicon(tuple(sorted(entries.items())), tuple(sorted({*exceptions, *harmless})), (0.0, 0.0, 0.0))

    def measured(batches):
        automaton = lexicon.automaton()
        for batch in _parts(batches):
            found = [measures(*matched(fold(t), automaton)) for t in strings(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column("toxic")],
                names=["a", "b", "toxic"],
            )

    got = rows.select("toxic", "text").mapInArrow(measured, "a double, b double, toxic int").collect()
    got.sort()
    x = np.array([(r.a, r.b) for r in got]).reshape(-1, 2)
    y = np.array([min(r.toxic, 1) for r in got], float)
    return Lexicon(lexicon.weights, lexicon.exceptions, fit_curve(x, y))


def _scores(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in _parts(batches):
            found = [_score(lexicon.curve, *matched(fold(t), automaton)) for t in strings(batch.column("text")).to_pylist()]
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.float64())], names=[*names, "score"])

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = bounded(docs).select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text"))
    got = rows.mapInArrow(_scores(lexicon), "doc_id bigint, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in _parts(batches):
            texts = strings(batch.column("text")).to_pylist()
            yield batch.filter(pa.array([_score(lexicon.curve, *matched(fold(t), automaton)) < threshold for t in texts], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
