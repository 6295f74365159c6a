"""Importance resampling towards a target distribution over hashed word runs.

Features of a text are its runs of 1 to `longest` consecutive words, joined by one space, repeats counted; a feature's
bucket is the CRC-32 of its bytes modulo `buckets`. What a bucket gains is the log ratio of its smoothed shares in the target
texts and in all documents; a document's weight is its features' mean gain, and the highest of weight + Gumbel noise are drawn.

1. Words, and pairs of words where runs of two are asked for, are counted over all documents. Up to HEAD most frequent words
   are broadcast with their CRC states, up to PAIRS most frequent pairs with their buckets: exact values, so that what is
   in the head changes speed alone. Words beyond HEAD_BYTES bytes are never in it, which bounds what is broadcast.
2. One pass over the texts turns each document into a list of bucket numbers: from the head, by going on from a head word's
   state, or by a CRC of the feature's own bytes in the tail. The lists are stored; texts are not read again.
3. Bucket totals are sums of the tasks' counts, exact, at most `buckets` rows a task. The driver holds `buckets` gains.
4. Weights come from the lists and the gains. Scores are ranked by a range sort and prefix sums over its parts.

Defined results: a null or empty text has no features, weight 0 and is never drawn; a null id counts as an empty one in the noise and
comes last among ties; rows that share an id and a score are ranked by their features; repeated rows are documents of their
own; empty documents give an empty table; an empty target gives gains by the smoothed shares alone; other columns don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, numbered, remove, utf8, written

#: Frequent words and pairs that are broadcast, and the longest such word.
HEAD, PAIRS, HEAD_BYTES = 65_536, 65_536, 64
#: Distinct words and pairs that a task counts before it passes the counts on.
COUNTED = 200_000
LONGEST, BUCKETS, SEED = 1, 10_000, 2024
#: Documents with fewer words are never drawn; of the others, this percentage is.
LEAST_WORDS, PERCENT = 20, 10

#: Lower-cases A-Z and makes each separator a space: all below 0x80 but digits and letters.
FOLD = bytes((b + 32 if chr(b) in UPPER else b) if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


class States(dict):
    """CRC-32 of words: of head words looked up, of others computed each time."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def bucket_list(words: list[bytes], states: States, pairs: dict[tuple[bytes, bytes], int], longest: int, buckets: int) -> np.ndarray:
    """The buckets of all features, in order of length and place."""
    first = np.fromiter(map(states.__getitem__, words), np.int64, len(words))
    out = [first % buckets]
    if longest > 1:
        found = [pairs.get(p) for p in pairwise(words)]
        out.append(np.array([zlib.crc32(words[k + 1], zlib.crc32(b" ", int(first[k]))) % buckets if b is None else b for k, b in enumerate(found)], np.int64))
    for n in range(3, longest + 1):
        out.append(np.array([zlib.crc32(b" ".join(words[k : k + n])) % buckets for k in range(len(words) - n + 1)], np.int64))
    return np.concatenate(out)


def head_counts(docs: DataFrame, longest: int) -> DataFrame:
    """(a, b, n) of all words (b null) and, if longest is over 1, all pairs of words that may be in the head."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            keys = [k if isinstance(k, tuple) else (k, None) for k in held]
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.binary()), pa.array(held.values(), pa.int64())], names=["a", "b", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in utf8(batch.column("text")):
                words = words_of(text)
                for k in range(0, len(words), COUNTED):
                    part = words[k : k + COUNTED + 1]
                    held.update(w for w in part[:COUNTED] if len(w) <= HEAD_BYTES)
                    if longest > 1:
                        held.update(p for p in pairwise(part) if len(p[0]) + len(p[1]) <= HEAD_BYTES)
                    if len(held) >= COUNTED:
                        yield passed_on()
        if held:
            yield passed_on()

    return docs.select("text").mapInArrow(count, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def size_class(n: Column) -> Column:
    """Rises with n, in steps of a sixteenth of n at most: fewer than 1,024 classes."""
    bits = F.length(F.bin(n)).cast("long")
    return bits * 16 + F.call_function("shiftright", n, F.greatest(bits - 5, F.lit(0)).cast("int")).bitwiseAND(F.lit(15).cast("long"))


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of whole classes of n, from the highest, that are at most so many together: all that reaches the driver."""
    sizes = sorted(counted.groupBy(size_class(F.col("n")).alias("class")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    whole = [c for (c, _), total in zip(sizes, accumulate(r for _, r in sizes), strict=True) if total <= most]
    return counted.filter(size_class(F.col("n")) >= whole[-1]) if whole else counted.limit(0)


def head_of(docs: DataFrame, longest: int, buckets: int) -> tuple[States, dict[tuple[bytes, bytes], int]]:
    """CRC states of the most frequent words, and buckets of the most frequent pairs."""
    counted = written(head_counts(docs, longest).filter("n > 1"), "word-counts")
    states = States((bytes(r.a), zlib.crc32(r.a)) for r in most_frequent(counted.filter("b is null"), HEAD).collect())
    pairs = {(bytes(r.a), bytes(r.b)): zlib.crc32(bytes(r.a) + b" " + bytes(r.b)) % buckets for r in most_frequent(counted.filter("b is not null"), PAIRS).collect()} if longest > 1 else {}
    remove(counted)
    return states, pairs


def features(texts: DataFrame, key: str, head: tuple[States, dict], longest: int, buckets: int) -> DataFrame:
    """key, n_words, n_features, found (bucket numbers, unsigned 32-bit) of each text."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((dict(head[0]), head[1]))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, pairs = States(shared.value[0]), shared.value[1]
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                found = bucket_list(words, states, pairs, longest, buckets) if words else np.zeros(0, np.int64)
                rows.append((len(words), len(found), found.astype("<u4").tobytes()))
            n_words, n, found = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=[key, "n_words", "n_features", "found"])

    return texts.select(F.col(key).cast("long").alias(key), "text").mapInArrow(listed, f"{key} long, n_words long, n_features long, found binary")


def totals(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in batch.column("found").to_pylist():
                sums += np.bincount(np.frombuffer(part, "<u4"), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("found").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in raw)) of each bucket."""
    size, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + size)) / float((a + 1) * (t + size)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, tie."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found").to_pylist()
            weight = [int(gain[np.frombuffer(x, "<u4")].sum()) // (len(x) // 4) if x else 0 for x in lists]
            tie = [zlib.crc32(x) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64()), pa.array(tie, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "tie"])

    return found.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, tie long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel draw) from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each of docs (doc_id, text), drawn towards target (text); rank is null if it isn't drawn."""
    head = head_of(docs, longest, buckets)
    found = written(features(docs, "doc_id", head, longest, buckets), "bucket-lists")
    wanted = features(target.select(F.lit(0).alias("doc_id"), "text"), "doc_id", head, longest, buckets)
    gain = gains(totals(found, buckets), totals(wanted, buckets))
    scored = written(weighed(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    may = F.col("n_words") >= least_words
    place, n = numbered(scored.withColumn("may", may), [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "tie"], "place")
    drawn = percent * place.filter("may").count() // 100 if n else 0
    return place.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (F.col("place") < drawn), F.col("place") + 1).alias("rank"))


#: The classic table of the reversed polynomial 0xEDB88320, from its rule: eight shifts of each byte.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def oracle_sql(buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> str:
    """resample() with runs of one word, in DuckDB SQL; a CRC is folded over each distinct word's bytes."""
    shifts = ", ".join(f"c{k + 1} AS (SELECT i, {_STEP.format('v')} AS v FROM c{k})" for k in range(8))
    byte = "(('0x' || substr(x, k, 2))::BIGINT)"
    return f"""
WITH c0 AS (SELECT i, i AS v FROM range(256) r(i)), {shifts},
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM c8),
txt AS (SELECT row_number() OVER () AS row, doc_id, text, true AS raw FROM documents UNION ALL SELECT -item_id - 1, NULL, text, false FROM benchmark),
f AS (SELECT row, raw, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM txt),
p AS MATERIALIZED (SELECT row, raw, w, count(*)::BIGINT AS n FROM f GROUP BY ALL),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM p)),
b AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda k: {byte})), lambda a, d: xor(a >> 8, t[(xor(a & 255, d) + 1)::INT])), 4294967295) % {buckets} AS bucket FROM v, tab),
q AS (SELECT row, raw, bucket, n FROM p JOIN b USING (w)),
s AS (SELECT bucket, sum(CASE WHEN raw THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN raw THEN 0 ELSE n END)::DOUBLE AS t FROM q GROUP BY bucket),
a AS (SELECT sum(s) AS sa, sum(t) AS ta FROM s),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sa + {buckets}) / ((s + 1) * (ta + {buckets}))))::BIGINT AS gain FROM s, a),
m AS (SELECT row, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM q JOIN g USING (bucket) WHERE raw GROUP BY row),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
  ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM txt LEFT JOIN m USING (row) WHERE raw),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= {least_words}) OVER () AS may FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {least_words} AND place <= {percent} * may // 100 THEN place END AS rank FROM k
"""
