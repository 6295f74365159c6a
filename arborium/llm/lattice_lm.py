"""Language-model scores by subword lattices.

The pieces of an existing vocabulary are the arcs of a lattice over each word (a word starts with the
vocabulary's word mark). A piece has a unigram log probability; the probability of a word is the sum over all its
segmentations, by a forward recursion in log space, and a document's is the product over its words and one
end: score, the marginal probability of the document. Only a vocabulary of byte-pair merges is at hand, so its own
scores are ranks; piece probabilities start from them and are re-estimated on the training documents by expected counts
over all segmentations of all their words (ROUNDS rounds). The end has its share of them. A character that no piece
covers is spelled in bytes, at a small fixed probability. All pieces of the vocabulary that a lower-cased word can
have are used, whatever their length.

mixture_score is another model of the same words: a word seen in training has one more arc, for all of it: its count
less a discount, over all tokens; the discounts of all words are the lattice's share.

Words are scored once each, not once an occurrence:
1. Tokens of all documents are counted, in the task first, then by a shuffle on the token; the table grows with the corpus.
2. Each distinct token gets its lattice log probability, many words of one length at a time.
3. The HEAD most frequent tokens or fewer travel to all tasks, a bounded table; a document's other tokens are joined
   with the table by a shuffle. Both ways give the same sums, so no token is left out.

Words of any length are walked in strides, with the arcs of STRIDE characters in memory at a time.

Defined results: a null or empty text is one end; words are lower-cased in A-Z only; rows that repeat an id are
scored one by one; without training documents all counts are 0; an empty table gives an empty table; other
columns don't matter.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, keep_only, session, utf8, written

#: Distinct tokens that a task counts before it hands its counts on.
COUNTED = 400_000
#: Tokens at most that travel to all tasks.
HEAD = 250_000
ROUNDS = 2
#: Mass of all bytes together, for characters without a piece; pseudo-count of a piece.
BYTES_MASS, PSEUDO = 1e-5, 0.05
#: Lattice cells worked on at a time, and characters of a word whose arcs are in memory.
CELLS, STRIDE = 1 << 20, 4096
MARK = "▁"
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 18


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def log_sum(ways: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the first axis."""
    top = ways.max(0)
    return top + np.log(np.exp(ways - top).sum(0))


def code_points(words: list[str]) -> np.ndarray:
    """Matrix of the code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def vocabulary(path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Pieces that a lower-cased word can have, and their scores as log probabilities (before training)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_control(k) or model.is_byte(k) or model.is_unknown(k) or MARK in piece[1:]:
            continue
        if not any("A" <= c <= "Z" for c in piece):
            found[piece] = -math.log(10 - model.get_score(k))
    scores = np.array(list(found.values()))
    return list(found), scores - np.logaddexp.reduce(scores)


class Pieces:
    """Finds pieces by hashes of their code points: two tables of slots, no piece without a slot."""

    def __init__(self, pieces: list[str]):
        self.count = len(pieces)
        keys = np.zeros(self.count, np.uint64)
        lengths = np.array([len(p) for p in pieces])
        for n in set(lengths.tolist()):
            at = np.flatnonzero(lengths == n)
            points, h = code_points([pieces[k] for k in at]), np.full(len(at), SPREAD)
            for j in range(n):
                h = spread(h * SPREAD + points[:, j])
            keys[at] = h
        assert len(np.unique(keys)) == self.count
        slots = 1 << SLOT_BITS
        self.tables, left, shift = [], np.arange(self.count), 64 - SLOT_BITS
        while len(left):
            key, index = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
            slot = (keys[left] >> np.uint64(shift)) & np.uint64(slots - 1)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], index[slot[first]] = keys[left[first]], left[first]
            self.tables.append((shift, key, index))
            left, shift = np.delete(left, first), shift - 11
            assert shift >= 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the pieces with these hashes; -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        for shift, key, index in self.tables:
            slot = ((h >> np.uint64(shift)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            out = np.where(key[slot] == h, index[slot], out)
        return out


class Lattice:
    """Marginal log probabilities of words, and expected counts of pieces."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        self.names, self.pieces, self.longest = pieces, Pieces(pieces), max(map(len, pieces), default=1)
        self.logs = np.append(logs, -np.inf)

    def arcs(self, points: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, their logs) of the arcs that start at first up to last; [k, i] starts at first + i and has k + 1 characters."""
        m, n = points.shape
        width, starts = min(self.longest, m - first), last - first
        found, logs = np.full((width, starts, n), -1, np.int32), np.full((width, starts, n), -np.inf)
        h = np.full((starts, n), SPREAD)
        for k in range(width):
            live = min(starts, m - k - first)
            h = spread(h[:live] * SPREAD + points[first + k : first + k + live])
            found[k, :live] = self.pieces.find(h.ravel()).reshape(h.shape)
            logs[k, :live] = self.logs[found[k, :live]]
        here = points[first:last]
        size = 1 + (here > 0x7F).astype(int) + (here > 0x7FF) + (here > 0xFFFF)
        logs[0] = np.where(found[0] < 0, size * math.log(BYTES_MASS / 256), logs[0])
        return found, logs

    def forward(self, points: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of words of one length, given by code points; those of all their beginnings go to kept."""
        m, n = points.shape
        before, tail = 0, np.zeros((1, n))  # the beginnings of lengths from before on
        for first in range(0, m, STRIDE):
            last, base = min(m, first + STRIDE), max(0, first - self.longest + 1)
            _, logs = self.arcs(points, base, last)
            alpha = np.concatenate([tail[base - before :], np.full((last - first, n), -np.inf)])
            for j in range(first + 1, last + 1):
                k = np.arange(min(len(logs), j))
                alpha[j - base] = log_sum(alpha[j - 1 - k - base] + logs[k, j - 1 - k - base])
            if kept is not None:
                kept[base : last + 1] = alpha
            before, tail = base, alpha
        return tail[m - before]

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in words of one length, marks included, that occur so often."""
        points = code_points(words).T
        m, n = points.shape
        alpha, beta = np.full((m + 1, n), -np.inf), np.full((m + 1, n), -np.inf)
        self.forward(points, alpha)
        beta[m] = 0
        out = np.zeros(self.pieces.count + 1)
        for first in range((m - 1) // STRIDE * STRIDE, -1, -STRIDE):
            last = min(m, first + STRIDE)
            found, logs = self.arcs(points, first, last)
            for i in range(last - 1, first - 1, -1):
                k = np.arange(min(len(logs), m - i))
                beta[i] = log_sum(beta[i + k + 1] + logs[k, i - first])
            for k in range(len(logs)):
                live = min(last, m - k) - first
                if live > 0:
                    share = np.exp(alpha[first : first + live] + logs[k, :live] + beta[first + k + 1 : first + k + 1 + live] - alpha[m]) * counts
                    at = np.where(found[k, :live] < 0, self.pieces.count, found[k, :live])
                    out += np.bincount(at.ravel(), share.ravel(), self.pieces.count + 1)
        return out[:-1]

    def chunks(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """(places, marked words) of words of one length, CELLS lattice cells at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts) if len(order) else []:
            length = int(lengths[same[0]])
            step = max(1, CELLS // (length * min(length, self.longest)))
            for k in range(0, len(same), step):
                yield same[k : k + step], [MARK + words[p] for p in same[k : k + step]]

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word."""
        out = np.zeros(len(words))
        for at, marked in self.chunks(words):
            out[at] = self.forward(code_points(marked).T)
        return out


MADE: dict[str, Lattice] = {}


def lattice(pieces: list[str], logs: np.ndarray) -> Lattice:
    """A worker's lattice for a model: its piece tables are built once for a vocabulary."""
    keep_only(MADE)
    if "last" not in MADE or MADE["last"].names != pieces:
        MADE["last"] = Lattice(pieces, logs)
    MADE["last"].logs = np.append(logs, -np.inf)
    return MADE["last"]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_BYTES).split()


def strings(values) -> pa.Array:
    return pa.array(list(values), pa.binary()).cast(pa.string())


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, train, other) of all tokens but ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def out() -> pa.RecordBatch:
            found = list(train.keys() | other.keys())
            return pa.RecordBatch.from_arrays([strings(found), pa.array([train[t] for t in found], pa.int64()), pa.array([other[t] for t in found], pa.int64())], names=["token", "train", "other"])

        for batch in batches:
            for text, held in zip(utf8(batch.column("text")), batch.column("held").to_pylist(), strict=True):
                (other if held else train).update(tokens_of(text))
                if len(train) + len(other) > COUNTED:
                    yield out()
                    train.clear()
                    other.clear()
        yield out()

    read = docs.select("text", held_out(F.col("doc_id")).alias("held"))
    return read.mapInArrow(count, "token string, train long, other long").groupBy("token").agg(F.sum("train").alias("train"), F.sum("other").alias("other"))


def expected_counts(counts: DataFrame, pieces: list[str], logs: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all training tokens, each distinct one walked once; a row for each piece, no more, comes to the driver."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = lattice(pieces, logs), np.zeros(len(pieces))
        for batch in batches:
            often = batch.column("train").to_numpy().astype(float)
            for at, marked in model.chunks(batch.column("token").to_pylist()):
                total += model.expect(marked, often[at])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["piece", "n"])

    found = counts.filter("train > 0").select("token", "train").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(pieces))
    out[found.column("piece").to_numpy()] = found.column("n").to_numpy()
    return out


def trained(counts: DataFrame, words: int, ends: int, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, float]:
    """Pieces, their log probabilities after some rounds of re-estimation, and the end's."""
    pieces, logs = vocabulary()
    end = (ends + 0.5) / (words + ends + 1)
    for _ in range(rounds):
        n = expected_counts(counts, pieces, logs) + PSEUDO
        end = (ends + 0.5) / (n.sum() + ends + 1)
        logs = np.log(n / n.sum()) + math.log1p(-BYTES_MASS) + math.log1p(-end)
    return pieces, logs, math.log(end)


def token_scores(counts: DataFrame, pieces: list[str], logs: np.ndarray, total: int, types: int, discount: float) -> DataFrame:
    """counts with the token's log10 probabilities: lattice, over all segmentations, and mixture, with its whole-word arc."""
    share = math.log(discount * types / total) if total and types else 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(pieces, logs)
        for batch in batches:
            n = batch.column("train").to_numpy()
            whole = np.log(np.maximum(n - discount, 1e-300) / max(total, 1))
            marginal = model.score(batch.column("token").to_pylist())
            both = np.logaddexp(whole, share + marginal)
            yield batch.append_column("lattice", pa.array(marginal / math.log(10))).append_column("mixture", pa.array(both / math.log(10)))

    return counts.mapInArrow(score, "token string, train long, other long, lattice double, mixture double")


def head_of(scores: DataFrame, most: int = HEAD) -> pa.Table:
    """At most so many of the most frequent tokens: all whose count reaches a level found from a histogram."""
    total = F.col("train") + F.col("other")
    level = F.floor(F.log2(total) * 16).cast("long")
    sizes = sorted(((r["level"], r["n"]) for r in scores.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    room, least = most, None
    for at, n in sizes:
        room -= n
        if room < 0:
            break
        least = at
    if least is None:
        return pa.table({"token": pa.array([], pa.string()), "train": pa.array([], pa.int64()), "lattice": pa.array([], pa.float64()), "mixture": pa.array([], pa.float64())})
    return scores.filter(level >= least).select("token", "train", "lattice", "mixture").toArrow()


HEADS: dict[str, tuple] = {}


def looked_up(name: str, sent) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """A worker's dictionary of the head tokens sent under a name, kept between tasks: places, counts, lattice and mixture scores."""
    keep_only(HEADS)
    if name not in HEADS:
        HEADS.clear()
        with pa.ipc.open_stream(sent.value) as stream:
            table = stream.read_all()
        places = {t: k for k, t in enumerate(utf8(table.column("token").combine_chunks()))}
        HEADS[name] = (places, *(table.column(c).to_numpy() for c in ("train", "lattice", "mixture")))
    return HEADS[name]


def partial_sums(docs: DataFrame, head, unit: float) -> DataFrame:
    """A row for each document with the sums over its head tokens, and one for each other token of it."""
    names = ["row", "doc_id", "token", "n", "known", "base", "lattice", "mixture"]
    sending = uuid.uuid4().hex
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, train, logs, mixed = looked_up(sending, head)
        base = np.log10(train + 0.5) - unit
        known = (train > 0).astype(np.int64)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, rest = [], []
            for name, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                words = tokens_of(text)
                at = np.fromiter((places.get(w, -1) for w in words), np.int64, len(words))
                here = at[at >= 0]
                docs.append((row, name, None, len(words), int(known[here].sum()), float(base[here].sum()), float(logs[here].sum()), float(mixed[here].sum())))
                if len(here) < len(words):
                    rest += [(row, name, w, n, 0, 0.0, 0.0, 0.0) for w, n in Counter(words[k] for k in np.flatnonzero(at < 0)).items()]
                row += 1
            for part in (docs, rest):
                if part:
                    columns = list(zip(*part, strict=True))
                    yield pa.RecordBatch.from_arrays([strings(c) if n == "token" else pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(add, "row long, doc_id long, token string, n long, known long, base double, lattice double, mixture double")


def score_documents(docs: DataFrame, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and mixture_score of each document."""
    spark = session(docs)
    counts = written(token_counts(docs), "token-counts")
    ends = docs.filter(~held_out(F.col("doc_id"))).count()
    words, types, once, twice = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), *(F.count_if(c) for c in (F.col("train") > 0, F.col("train") == 1, F.col("train") == 2))).first()
    total, distinct = words + ends, types + (ends > 0)
    unit = math.log10(total + 0.5 * (distinct + 1))
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    whole_end = math.log10(ends / total) if ends else 0.0
    pieces, logs, end = trained(counts, words, ends, rounds)
    scores = written(token_scores(counts, pieces, logs, total, types, discount), "token-scores")
    table = head_of(scores, head)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    sums = written(partial_sums(docs, sent, unit), "document-sums")
    rest = sums.filter("token is not null").select("row", "token", "n").join(scores.select("token", "train", "lattice", "mixture"), "token")
    looked = rest.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.when(F.col("train") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * (F.log10(F.col("train") + 0.5) - unit)).alias("base"), *((F.col("n") * F.col(c)).alias(c) for c in ("lattice", "mixture")))
    own = sums.filter("token is null").select("row", "doc_id", "n", "known", "base", "lattice", "mixture")
    added = own.unionByName(looked).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n", "known", "base", "lattice", "mixture")))
    return added.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(ends + 0.5) - unit).alias("base_score"),
        (F.col("lattice") + end / math.log(10)).alias("score"),
        (F.col("mixture") + whole_end).alias("mixture_score"),
    )
