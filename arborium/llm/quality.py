"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a document or passes it on. The cost and the selectivity of each rule are measured on a
sample; the cascade then asks the rules in descending order of rejections per second of cost, and a
document is asked no further rule after its first rejection (branches of one CASE, evaluated lazily).
The order changes what the cascade costs and which rule is named, never whether a document is kept.

Base features are exact and made inside a row: no shuffle, so no group of any kind meets in a task. The sample is drawn
from all rows and stays on the executors; its features are stored once, and rules are timed on the stored table.

Defined results: a null or empty text has no words and fails the base; repeated rows are judged one by
one; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, remove, squeeze, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows, about, of the sample on which rules are timed; the sample only sets the order of the rules.
SAMPLE_ROWS = 512
SAMPLE_SEED = 7


@dataclass(frozen=True)
class Rule:
    """reject is a boolean column over text, words, n_words and the base features."""

    name: str
    reject: Callable[[], Column]


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(w: Column) -> Column:
    """How many words lie in a WINDOW-word window that the array holds twice or more.

    Hashes of the windows tell most documents to have no repeat; the others compare whole windows.
    """
    count = F.size(w) - (WINDOW - 1)
    at = lambda i: F.slice(w, i, WINDOW)
    hashes = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(at(i)))
    windows = F.array_sort(F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(F.array_join(at(i), " ").alias("w"), i.alias("i"))))
    same = lambda p, x, k: F.coalesce(F.get(p, k)["w"] == x["w"], F.lit(False))

    def starts(p: Column) -> Column:
        marked = F.transform(p, lambda x, k: F.when(same(p, x, k - 1) | same(p, x, k + 1), x["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def covered(s: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(s, first, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    exact = let(windows, lambda p: covered(starts(p)))
    return F.when(count < 2, F.lit(0).cast("long")).when(F.size(F.array_distinct(hashes)) == count, F.lit(0).cast("long")).otherwise(exact)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: squeeze(x) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, words and the base features."""
    read = docs.select(key, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = read.select("*", words(F.col("text")).alias("words"))
    return split.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(squeeze(F.col("text"))).cast("long").alias("word_chars"),
        count_chars(F.col("text"), SYMBOLS).alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def share(count: Column, percent: int, of: Column) -> Column:
    return 100 * count > percent * of


#: Thresholds are in percent and far from what running prose has.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda: share(F.col("n_symbols"), 15, F.col("n_words"))),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("repeated_lines", lambda: share(F.col("n_dup_lines"), 30, F.size(F.split("text", "\n")))),
    Rule("capitals", lambda: share(count_chars(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 40, F.col("word_chars"))),
    Rule("exclamations", lambda: share(count_chars(F.col("text"), "!"), 50, F.col("n_words"))),
    Rule("few_letters", lambda: share(F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))).cast("long"), 40, F.col("n_words"))),
    Rule("one_word", lambda: F.size(F.array_distinct("words")) * 50 < F.col("n_words")),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def take_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About so many rows, each drawn with the same chance; all rows of a table with fewer."""
    share = rows / max(docs.count(), 1)
    return docs if share >= 1 else docs.sample(share, seed=SAMPLE_SEED)


def measure(sample: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id") -> list[Measured]:
    """Seconds and share of rejections of each rule over the sample's features, made once before."""
    made = written(features(sample, key), "quality-sample")
    passed = made.filter(~base_failed())
    read = (F.max(F.length("text")), F.max(F.size("words")))  # each run reads the same columns

    def run(column: Column) -> tuple[float, int]:
        began = time.perf_counter()
        n = passed.agg(F.count_if(column), *read).first()[0]
        return time.perf_counter() - began, n

    rows = passed.count()
    nothing = min(run(F.col("n_words") < 0)[0] for _ in range(3))
    out = []
    for rule in rules:
        run(rule.reject())  # compiles it
        seconds, n = run(rule.reject())
        out.append(Measured(rule, max(seconds - nothing, 1e-4), n / max(rows, 1)))
    remove(made)
    return out


def ordered(measured: Sequence[Measured]) -> list[Rule]:
    return [m.rule for m in sorted(measured, key=lambda m: -m.worth)]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects; null if none does."""
    out = F
    for rule in rules:
        out = out.when(F.coalesce(rule.reject(), F.lit(False)), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, base features, base_failed, rejected_by (the first rule that rejects, or base) and kept of each document."""
    order = ordered(measure(take_sample(docs.select("doc_id", "text"), sample_rows), rules))
    made = features(docs)
    verdict = F.when(base_failed(), F.lit("base")).otherwise(cascade(order))
    judged = made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.alias("rejected_by"))
    return judged.withColumn("kept", F.col("rejected_by").isNull())


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM wins) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(8, i - prev))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, i, lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM dup) GROUP BY doc_id),
f AS (SELECT d.doc_id, d.text, d.words, len(d.words)::BIGINT AS n_words,
             length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(d.lines) - len(list_distinct(d.lines)))::BIGINT AS n_dup_lines,
             coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep r ON d.doc_id = r.doc_id),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT 100 * n_symbols > 15 * n_words
       AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words)
       AND NOT 100 * n_dup_lines > 30 * len(string_split(text, chr(10)))
       AND NOT 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 40 * word_chars
       AND NOT 100 * (length(text) - length(replace(text, '!', ''))) > 50 * n_words
       AND NOT 100 * len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{L}'))) > 40 * n_words
       AND NOT len(list_distinct(words)) * 50 < n_words AS kept
FROM g
"""
