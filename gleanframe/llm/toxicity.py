"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguises: case, look-alike letters of other scripts, full-width forms, zero-width
characters and digits or signs that stand for letters. Terms match at the start of a folded word,
so that a stem finds its inflected forms; a hit inside an exception phrase does not count. Counts
are damped and put in relation to the length of the text, and a logistic curve turns them into a
score from 0 to 1.

The lexicon is learned from labelled rows only: prefixes of words that mark the toxic class, chosen
one by one so that each explains toxic rows which the earlier ones do not; then the weights are fitted
by penalised logistic regression. Learning uses at most ``SAMPLE_ROWS`` labelled rows (those with the
smallest hash of their id), a documented bound; counting the terms is a distributed aggregation over
these, and at most ``MAX_CANDIDATES`` candidates and one short list of hits per sampled row reach
the driver. Scoring covers all rows and whole texts, one pass, no shuffle.

Defined results: a null or empty text has no hits and gets the score of the intercept. Null or
repeated ids score like any row. Labels other than 0 and 1 are ignored; of several labels of an id
the largest counts. Without usable labels of both classes the seed lexicon scores alone.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.llm.common import written

SAMPLE_ROWS = 20_000
MAX_CANDIDATES = 4_000
THRESHOLD = 0.3
SHORTEST, LONGEST = 4, 10
#: A term must mark so many toxic rows of the sample, and be right about so many of its rows.
MIN_ROWS, MIN_PRECISION = 4, 0.85

# Common insults, used where there are no labels to learn from.
SEED_TERMS = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()
# Phrases in which a term is harmless.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "sore loser board", "stupidity test")

# What stands for a Latin letter. Cyrillic, Greek, then digits and signs.
LOOK_ALIKES = (
    ("аӓ", "a"), ("в", "b"), ("с", "c"), ("ԁ", "d"), ("е", "e"), ("һ", "h"), ("іїı", "i"), ("ј", "j"),
    ("к", "k"), ("ӏ", "l"), ("м", "m"), ("п", "n"), ("о", "o"), ("р", "p"), ("ѕ", "s"), ("т", "t"),
    ("ѵ", "v"), ("ѡ", "w"), ("х", "x"), ("у", "y"),
    ("α", "a"), ("β", "b"), ("ε", "e"), ("η", "n"), ("ι", "i"), ("κ", "k"), ("ν", "v"), ("ο", "o"),
    ("ρ", "p"), ("τ", "t"), ("υ", "u"), ("χ", "x"), ("γ", "y"), ("ω", "w"),
    ("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"), ("9", "g"),
    ("@", "a"), ("$", "s"), ("!", "i"),
)
# Code points that show nothing.
INVISIBLE = (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)


def folding_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): letter for many, letter in LOOK_ALIKES for c in many}
    table |= {0xFF41 + i: chr(97 + i) for i in range(26)}  # full-width letters
    table |= {c: None for c in INVISIBLE}
    for c in '\t\n\x0b\x0c\r"#%&\'()*+,-./:;<=>?[\\]^_`{|}~':
        table.setdefault(ord(c), " ")
    return table


def fold(text: str | None, table: dict) -> str:
    """The folded text with a blank before and after it."""
    return f" {(text or '').lower().translate(table)} "


def automaton(terms, exceptions=EXCEPTIONS):
    """Terms get their index, exception phrases -1; both start at a word."""
    tree = ahocorasick.Automaton()
    for phrase in exceptions:
        tree.add_word(f" {phrase}", (-1, len(phrase) + 1))
    for i, term in enumerate(terms):
        tree.add_word(f" {term}", (i, len(term) + 1))
    if len(tree):
        tree.make_automaton()
    return tree


def hits(folded: str, tree) -> Counter:
    """Hits by term. Of the terms that begin at one word the longest counts; exceptions hide it."""
    if not len(tree):
        return Counter()
    best: dict[int, tuple[int, int]] = {}
    for end, (term, length) in tree.iter(folded):
        start = end - length
        kept = best.get(start)
        if term < 0 or kept is None or (kept[0] >= 0 and length > kept[1]):
            best[start] = (term, length)
    return Counter(term for term, _ in best.values() if term >= 0)


class Model(NamedTuple):
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    density: float
    """Weight of the damped hits in relation to the length."""

    def score(self, found: Counter, n_words: int) -> float:
        mass = sum(self.weights[t] * math.log2(1 + n) for t, n in found.items())
        z = self.intercept + mass * (1 + self.density * per_length(n_words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def per_length(n_words: int) -> float:
    """From near 1 for a short text down to 0 for a very long one."""
    return 1 / math.sqrt(1 + n_words / 100)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, toxic`` of the sampled rows that may be learned from.

    The sample has ``sample_rows`` ids and labels at most, a bound that lets it be broadcast: the texts stay.
    """
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", "toxic")


def _counted(table):
    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                words = {w for w in fold(text, table).split() if len(w) >= SHORTEST}
                for term in {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}:
                    seen.setdefault(term, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(seen), pa.string()),
                pa.array([x[0] for x in seen.values()], pa.int64()),
                pa.array([x[1] for x in seen.values()], pa.int64()),
            ],
            names=["term", "clean", "toxic"],
        )

    return count


def _listed(table, terms):
    numbers = pa.list_(pa.int32())

    def list_(batches):
        tree = automaton(terms, ())
        for batch in batches:
            words, found = [], []
            for text in batch.column(0).to_pylist():
                folded = fold(text, table)
                words.append(folded.count(" ") - 1)
                found.append(Counter(t for _, (t, _) in tree.iter(folded)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).cast(pa.int32()),
                    pa.array(words, pa.int32()),
                    pa.array([list(f) for f in found], numbers),
                    pa.array([list(f.values()) for f in found], numbers),
                ],
                names=["toxic", "n_words", "terms", "counts"],
            )

    return list_


def _explaining(terms, rows) -> list[int]:
    """Terms in the order in which each explains the most toxic rows not explained before."""
    holders: dict[int, set[int]] = {}
    for r, row in enumerate(rows):
        for t in row.terms:
            holders.setdefault(t, set()).add(r)
    toxic = {r for r, row in enumerate(rows) if row.toxic}
    clean_of = {t: len(h - toxic) for t, h in holders.items()}
    open_rows, chosen = set(toxic), []
    while True:
        # Of equally good prefixes the longest names the stem.
        gain = lambda t: (len(holders[t] & open_rows) - 3 * clean_of[t], len(terms[t]), terms[t])
        best = max((t for t in holders if t not in chosen), key=gain, default=None)
        if best is None or gain(best)[0] < MIN_ROWS:
            return chosen
        chosen.append(best)
        open_rows -= holders[best]


def _fitted(
    x: np.ndarray, y: np.ndarray, expected: np.ndarray, penalty: float = 0.5, rounds: int = 25
) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to the ``expected`` weights; column 0 is the intercept."""
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge * (beta - expected)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        beta = beta + np.linalg.solve(hessian, gradient)
    return beta


SEED_WEIGHT = 3.0
SEED_MODEL = Model(tuple(SEED_TERMS), (SEED_WEIGHT,) * len(SEED_TERMS), -3.0, 0.5)


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    table = folding_table()
    rows = written(training_rows(documents, labels, sample_rows), "toxicity")
    precise = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    candidates = [
        row.term
        for row in rows.mapInArrow(_counted(table), "term string, clean long, toxic long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= MIN_ROWS) & (precise >= MIN_PRECISION))
        .orderBy(F.col("toxic") - 3 * F.col("clean"), F.length("term"), "term", ascending=False)
        .limit(MAX_CANDIDATES)
        .collect()
    ]
    candidates = list(dict.fromkeys([*SEED_TERMS, *candidates]))
    found = rows.mapInArrow(
        _listed(table, candidates), "toxic int, n_words int, terms array<int>, counts array<int>"
    ).collect()
    if len({row.toxic for row in found}) < 2:
        return SEED_MODEL
    chosen = _explaining(candidates, found)
    # Seed terms stay in: without evidence they keep their seed weight.
    terms = [candidates[t] for t in chosen] + [t for t in SEED_TERMS if candidates.index(t) not in chosen]
    index = {candidates.index(t): i for i, t in enumerate(terms)}
    x = np.zeros((len(found), len(terms) + 1))
    x[:, 0] = 1
    for r, row in enumerate(found):
        for t, n in zip(row.terms, row.counts):
            if t in index:
                x[r, 1 + index[t]] = math.log2(1 + n) * (1 + 0.5 * per_length(row.n_words))
    y = np.array([float(row.toxic) for row in found])
    beta = _fitted(x, y, np.array([0.0, *(SEED_WEIGHT * (t in SEED_TERMS) for t in terms)]))
    return Model(tuple(terms), tuple(float(b) for b in beta[1:]), float(beta[0]), 0.5)


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without their text but with ``n_hits, score, predicted``, in one pass."""
    table = folding_table()
    added = ("n_hits", "score", "predicted")
    rest = [c for c in documents.columns if c not in added and c != text]

    def scored(batches):
        tree = automaton(model.terms)
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            found = [(hits(t, tree), t.count(" ") - 1) for t in (fold(x, table) for x in texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([sum(f.values()) for f, _ in found], pa.int64()),
                    pa.array([model.score(f, n) for f, n in found], pa.float64()),
                ],
                names=[*rest, "n_hits", "score"],
            )

    schema = documents.select(*rest).schema.add("n_hits", "long").add("score", "double")
    return (
        documents.select(*rest, text)
        .mapInArrow(scored, schema)
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def keep_clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with the columns they came with."""
    table = folding_table()
    text = documents.columns.index("text")

    def clean(batches):
        tree = automaton(model.terms)
        for batch in batches:
            folded = [fold(t.as_py(), table) for t in batch.column(text)]
            low = [model.score(hits(t, tree), t.count(" ") - 1) < threshold for t in folded]
            yield batch.filter(pa.array(low, pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)
