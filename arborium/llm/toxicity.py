"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded word by word: look-alike letters of other scripts, digits and signs that stand for letters,
and accents are mapped to a-z, everything else inside a word is dropped ("1d!0t" and "іdіоt" become "idiot").
The lexicon is learned from labelled rows: folded words in MIN_COUNT toxic texts or more and far more often there than
in others, at any size of the table, weighted by their log odds. A text's score is the logistic of the weight of its
matches, normalised by its length; matches inside an exception phrase don't count. Exception phrases are two
words, one of them a term, that stand surely more often in texts labelled harmless; some are given. Only the text enters
a score.

Learning reads at most MOST_LABELLED labelled rows, chosen by a hash of the id, one text an id; copies and near copies,
texts of one class that share the smallest hash of their five-word shingles, count once, so that a group of copies doesn't
make its words look toxic. A lexicon has less terms than these rows have words, so it travels with the tasks.
Scoring covers every whole text.

Defined results: a null or empty text has no matches and scores the model's floor; without labels of both
classes the lexicon is empty and all texts score 0; an id labelled both ways counts as toxic; of rows that share a labelled
id one text is learned from, the one with the smallest hash; repeated rows are scored one by one; other columns are
carried along.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep_only, let, utf8, written

THRESHOLD = 0.3
#: Bounds of learning, all documented parameters.
MOST_LABELLED = 40_000
MIN_COUNT = 4
#: A term's log odds less CERTAIN times their standard error must reach this; the odds that a text with an exception phrase is harmless must surely exceed one.
MIN_WEIGHT = 1.0
CERTAIN = 1.64
#: Words of a shingle by which copies are known.
SHINGLE = 5
#: Words at which length halves the weight of a match, softly: weight / (1 + log(1 + words / LENGTH)).
LENGTH = 1000

# fmt: off
# Letters and signs that stand for a-z.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e",
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ß": "ss",
}
# Phrases in which a term is harmless; further ones are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof")
# fmt: on


def fold(word: bytes) -> str:
    """A word as letters a-z; signs at its ends are punctuation, inside they may stand for letters."""
    plain = unicodedata.normalize("NFKD", word.decode()).lower()
    first, last = 0, len(plain)
    while first < last and not (plain[first].isalnum() or plain[first] in "@$"):
        first += 1
    while last > first and not (plain[last - 1].isalnum() or plain[last - 1] == "@"):
        last -= 1
    return "".join(c for c in "".join(LOOKALIKES.get(c, c) for c in plain[first:last]) if "a" <= c <= "z")


class Folder(dict):
    """word -> folded word, kept between tasks."""

    limit = 400_000

    def __missing__(self, word: bytes) -> str:
        folded = fold(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = folded
        return folded


FOLDED = Folder()


def keep_words() -> None:
    keep_only(FOLDED)


def folded_words(text: bytes | None) -> list[str]:
    return list(map(FOLDED.__getitem__, (text or b"").split()))


@dataclass
class Model:
    """weights: term -> log odds; a text scores logistic(bias + slope * normalised weight)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    slope: float = 0.0
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        """Terms and exception phrases between spaces; a value is (characters, weight)."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(f" {term} ", (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, value: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.bias + self.slope * value)))) if self.weights else 0.0


def weigh(automaton, text: bytes | None) -> float:
    """Sum of the weights of matches outside exception phrases, normalised by length."""
    folded = folded_words(text)
    if not folded or not len(automaton):
        return 0.0
    hits = [(end - size, end, weight) for end, (size, weight) in automaton.iter(" " + " ".join(folded) + " ")]
    harmless = sorted((a, b) for a, b, w in hits if w is None)
    starts, reach = [a for a, _ in harmless], list(accumulate((b for _, b in harmless), max))
    total = 0.0
    for a, b, w in hits:
        before = bisect_right(starts, a)
        if w is not None and not (before and reach[before - 1] >= b):
            total += w
    return total / (1 + math.log1p(len(folded) / LENGTH))


def class_counts(labelled: DataFrame, found_in: Callable[[list[str]], Iterable[str]]) -> DataFrame:
    """(term, toxic, other): texts of each class in whose folded words found_in finds a term; counted in the task before any shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words()
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                for w in set(found_in(folded_words(text))):
                    seen.setdefault(w, [0, 0])[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["term", "toxic", "other"])

    return labelled.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def phrases_with(terms: set[str]) -> Callable[[list[str]], Iterator[str]]:
    """Finds the pairs of neighbouring words of which one is a term."""
    return lambda words: (f"{a} {b}" for a, b in zip(words, words[1:]) if a and b and (a in terms or b in terms))  # noqa: B905


def values_of(docs: DataFrame, model: Model, label: str) -> DataFrame:
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words()
        automaton = model.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([weigh(automaton, t) for t in utf8(batch.column("text"))], pa.float64()), batch.column(label)], names=["value", "label"])

    return docs.select("text", label).mapInArrow(weighed, "value double, label int")


def logistic_fit(value: np.ndarray, label: np.ndarray, penalty: float = 1.0) -> tuple[float, float]:
    """Bias and slope by Newton's method, with a penalty on the slope against its endless growth."""
    x, beta = np.stack([np.ones_like(value), value], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, penalty])
        step = np.linalg.solve(hessian, x.T @ (label - p) - np.array([0, penalty]) * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def learn(labelled: DataFrame) -> Model:
    """A model from the training rows that labelled_rows() gives."""
    first = labelled.groupBy("copy", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = labelled.join(first, "doc_id", "left_semi").select("text", "toxic")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    if not toxic or not other:
        return Model()
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    weight, error = F.log(a / (toxic + 1)) - F.log(b / (other + 1)), CERTAIN * F.sqrt(1 / a + 1 / b)
    terms = class_counts(rows, lambda words: (w for w in words if len(w) > 2)).filter(F.col("toxic") >= MIN_COUNT).withColumn("weight", weight).filter(F.col("weight") - error >= MIN_WEIGHT)
    model = Model({r["term"]: float(r["weight"]) for r in terms.collect()})
    harmless = class_counts(rows, phrases_with(set(model.weights))).filter(F.col("other") >= MIN_COUNT).filter(F.log(b / a) - error > 0)
    model.exceptions = (*EXCEPTIONS, *sorted(r["term"] for r in harmless.collect()))
    fitted = values_of(rows, model, "toxic").toPandas()
    model.bias, model.slope = logistic_fit(fitted["value"].to_numpy(), fitted["label"].to_numpy().astype(float))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def copy_key(text: Column) -> Column:
    """The smallest hash of a text's shingles: equal texts share it, near copies mostly do."""
    words = F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+")
    return let(words, lambda w: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - SHINGLE + 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text, toxic, copy of at most so many labelled documents that aren't held out, one row an id, as a table.

    The labels are chosen before any text is read; being so few, they travel to the texts.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    single = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("doc_id", F.col("least.text").alias("text"), "toxic")
    return written(single.withColumn("copy", copy_key(F.col("text"))), "labelled")


def scorer(model: Model):
    """A column function text -> score."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_words()
        automaton = model.automaton()
        for batch in texts:
            yield pa.array([model.score(weigh(automaton, t)) for t in utf8(batch)], pa.float64())

    return score


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = learn(labelled_rows(docs, labels))
    scored = docs.select("doc_id", scorer(model)("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below THRESHOLD."""
    (score,) = fresh(docs, "toxicity")
    return docs.withColumn(score, scorer(learn(labelled_rows(docs, labels)))("text")).filter(F.col(score) < THRESHOLD).select(*docs.columns)
