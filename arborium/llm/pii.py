"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, checksum validators (Luhn for cards, mod-97 for account numbers)
confirm them, and words near a span adjust its score. Four base kinds stay whatever their score; the
further kinds stay if they reach THRESHOLD.

Positions come from the lengths of the pieces between matches, so no text leaves the JVM. Offsets are
code points, ends exclusive. Patterns use possessive runs and start only where a run starts (or where
the last match ended): the same matches, found in one pass over texts of any length. Contexts and masked texts are
read from blocks of the text, never by walking from its start, so work is near linear in length and spans.

Defined results: a null text is empty and has no spans; repeated rows are handled one by one; an empty
table gives an empty table; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

THRESHOLD = 0.5
#: Characters before a span in which a context word counts, and what it adds.
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
#: Code points in a piece of a text from which contexts and gaps are read.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """needs: a character without which a text has no match, or None."""

    name: str
    pattern: str
    needs: str | None
    confirm: Callable[[Column], Column]
    score: float
    context: tuple[str, ...]
    base: bool = True


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def between(value: Column, low: int, high: int) -> Column:
    return (value >= low) & (value <= high)


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Does an account number in capitals, without spaces, leave 1 by mod 97?"""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def small_parts(match: Column) -> Column:
    """Are all parts of a dotted number at most 255?"""

    def fits(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(match, r"\."), fits)


def card(match: Column) -> Column:
    return let(digits(match), lambda d: F.when(between(F.length(d), 12, 19), luhn(d)).otherwise(False))


KINDS: tuple[Kind, ...] = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, ("mail", "contact", "write to")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", small_parts, 0.5, ("ip", "host", "server", "address")),
    Kind("card", r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+", None, card, 0.7, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: between(F.length(digits(m)), 9, 15), 0.6, ("phone", "call", "tel", "mobile")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![A-Za-z0-9])", None, lambda m: let(F.translate(m, " ", ""), lambda a: F.when(between(F.length(a), 15, 34), mod97(a)).otherwise(False)), 0.9, ("iban", "account", "bank"), base=False),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.3, ("ssn", "social security", "national id", "tax id"), base=False),
)
ORDER = [k.name for k in KINDS]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """values joined from the first to each; join is associative. Reach doubles each round, so work is n log n."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")

    def double(a: Column, k: Column) -> Column:
        before = lambda i: F.get(a, i - F.call_function("shiftleft", F.lit(1), k))
        return F.transform(a, lambda v, i: F.when(before(i).isNull(), v).otherwise(join(before(i), v)))

    return F.aggregate(F.sequence(F.lit(0), rounds - 1), values, double)


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text cut by blocks(): only the blocks they lie in are read."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor(F.greatest(start, end - 1) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(cut, first + 1, last - first + 1), ""), (start - first * BLOCK).cast("int") + 1, (end - start).cast("int"))


def matches(text: Column, kind: Kind) -> Column:
    """Array of (start, end) of the kind's confirmed matches; their places come from the gaps between them."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def placed(found: Column) -> Column:
        steps = F.zip_with(found, F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found)), lambda m, gap: (F.length(m) + F.length(gap)).cast("bigint"))
        spans = let(running(steps, lambda a, b: a + b), lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"))))
        return F.transform(F.filter(spans, lambda s: kind.confirm(s["match"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    proposed = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))
    return F.when(F.contains(text, F.lit(kind.needs)), proposed).otherwise(none) if kind.needs else proposed


def scored(text: Column, kind: Kind) -> Column:
    """Array of (start, rank, end, kind, score, base), kept ones only; rank is the kind's place in KINDS."""

    def score(s: Column, cut: Column) -> Column:
        near = F.lower(part(cut, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"]))
        told = F.exists(F.array(*map(F.lit, kind.context)), lambda w: F.contains(near, w))
        total = kind.score + F.when(told, CONTEXT_GAIN).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(ORDER.index(kind.name)).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), F.least(total, F.lit(1.0)).alias("score"), F.lit(kind.base).alias("base"))

    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,base:boolean>>")
    out = let(matches(text, kind), lambda found: F.when(F.size(found) == 0, none).otherwise(let(blocks(text), lambda cut: F.transform(found, lambda s: score(s, cut)))))
    return out if kind.base else F.filter(out, lambda s: s["score"] >= THRESHOLD)


def spans(text: Column) -> Column:
    """All kept spans by start, then kind."""
    return F.array_sort(F.concat(*(scored(text, k) for k in KINDS)))


def with_spans(docs: DataFrame, into: str) -> DataFrame:
    return docs.withColumn(into, spans(F.coalesce(F.col("text"), F.lit(""))))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each document."""
    found = with_spans(docs.select("doc_id", "text"), "found")
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *(count(k.name) for k in KINDS if k.base), F.sha2(listed(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def masked_stage(docs: DataFrame) -> DataFrame:
    """The documents with each span, or group of overlapping spans, replaced by its first kind in capitals."""
    (found,) = fresh(docs, "pii_spans")
    text = F.coalesce(F.col("text"), F.lit(""))

    def masked(s: Column) -> Column:
        def pieces(reach: Column, cut: Column) -> Column:
            before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("bigint"))
            kept = F.transform(s, lambda x, i: F.when(x["start"] >= before(i), F.concat(part(cut, before(i), x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(""))
            return F.concat(F.array_join(kept, ""), part(cut, before(F.size(reach)), F.length(text).cast("bigint")))

        return let(running(F.transform(s, lambda x: x["end"]), F.greatest), lambda reach: let(blocks(text), lambda cut: pieces(reach, cut)))

    return with_spans(docs, found).withColumn("text", F.when(F.size(found) > 0, masked(F.col(found))).otherwise(F.col("text"))).select(*docs.columns)
