"""Hierarchical multi-length packing of tokenized documents into training sequences.

Windows have the sizes TIERS, powers of two up to the context. A document's full contexts become windows
of their own; its rest is routed to the smallest tier that holds it. From the longest tier down, each
routed piece opens a window of its tier; the gap is filled with the largest pieces of shorter tiers that fit,
and what is still open is closed by cutting a piece. Windows of shorter tiers are full as well, so
nothing is padded. The last pieces of a partition that can't fill a window are laid out in
sequences of descending powers of two.

Each scan partition packs its own documents in runs of RUN_TOKENS tokens, and what a run leaves goes to the
next run: no shuffle, bounded memory, and sequence ids that name the partition. Windows are dealt to
steps of STEP_TOKENS tokens, longest first, so that all steps of a run but the last hold the same
number of tokens (column step_id).

Defined results: a null text is empty and has the end id only; documents with equal or null ids are
documents of their own; an empty table gives no pieces; other columns don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import utf8
from .tokens import CACHED_WORDS, FEWER_WORDS, Encoder, default_path

CONTEXT = 2048
TIERS = (2048, 1024, 512, 256)
RUN_TOKENS = 1 << 21
STEP_TOKENS = 16 * CONTEXT
#: Pieces an output batch has at least.
BATCH = 4096

Piece = tuple[int, int, int]  # length, document's place, start in the document


class Pools:
    """Pieces by tier, each tier sorted by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.of = tiers, [[] for _ in tiers]

    def add(self, piece: Piece) -> None:
        tier = max(k for k, size in enumerate(self.tiers) if piece[0] <= size)
        insort(self.of[tier], piece)

    def fitting(self, first: int, gap: int) -> Piece | None:
        """The largest piece of the tiers from first on that fits a gap."""
        for pool in self.of[first:]:
            if at := bisect_right(pool, (gap, 1 << 62, 1 << 62)):
                return pool.pop(at - 1)
        return None

    def any(self, first: int) -> Piece | None:
        """Some piece of the tiers from first on, the longest of the shortest tier."""
        for pool in reversed(self.of[first:]):
            if pool:
                return pool.pop()
        return None


def fill(pools: Pools) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(tier size, pieces) of full windows, and the pieces left."""
    windows, left = [], []
    for tier, size in enumerate(pools.tiers):
        shorter = min(tier + 1, len(pools.tiers) - 1)
        while pools.of[tier]:
            window = [pools.of[tier].pop()]
            gap = size - window[0][0]
            while gap and (piece := pools.fitting(shorter, gap)):
                window.append(piece)
                gap -= piece[0]
            while gap and (piece := pools.any(tier)):
                length, doc, start = piece
                window.append((min(gap, length), doc, start))
                if length > gap:
                    pools.add((length - gap, doc, start + gap))
                gap -= min(gap, length)
            if gap:
                left += window
            else:
                windows.append((size, window))
    return windows, left


def powers(pieces: list[Piece], largest: int) -> list[tuple[int, list[Piece]]]:
    """The pieces as sequences of descending powers of two, all full."""
    out, queue, total = [], list(reversed(pieces)), sum(p[0] for p in pieces)
    while total:
        size = min(largest, 1 << (total.bit_length() - 1))
        total -= size
        window, gap = [], size
        while gap:
            length, doc, start = queue.pop()
            window.append((min(gap, length), doc, start))
            if length > gap:
                queue.append((length - gap, doc, start + gap))
            gap -= min(gap, length)
        out.append((size, window))
    return out


def steps(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """The step of each window, given in descending size: sizes are powers of two, so steps fill exactly."""
    out, step, room = [], 0, step_tokens
    for size, _ in windows:
        if size > room:
            step, room = step + 1, step_tokens
        out.append(step)
        room -= size
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(",")]


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, run_tokens: int = RUN_TOKENS, step_tokens: int = STEP_TOKENS, cached_words: int = CACHED_WORDS) -> DataFrame:
    """A row for each piece of a document, as SCHEMA says."""
    path = tokenizer or default_path()
    context = tiers[0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = Encoder.at(path, cached_words), TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        pieces: list[Piece] = []
        tokens, sequence, step = 0, 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, pieces, tokens, sequence, step
            pools, windows = Pools(tiers), []
            for length, doc, start in pieces:
                while length >= context:
                    windows.append((context, [(context, doc, start)]))
                    length, start = length - context, start + context
                if length:
                    pools.add((length, doc, start))
            full, left = fill(pools)
            windows += full
            if last:
                windows += powers(left, context)
                left = []
            windows.sort(key=lambda w: -w[0])
            rows: list[tuple] = []
            for (size, window), at in zip(windows, steps(windows, step_tokens), strict=True):
                offset = 0
                for length, doc, start in window:
                    name, ids = held[doc]
                    rows.append((name, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base + sequence, offset, size, base + step + at))
                    offset += length
                sequence += 1
                if len(rows) >= BATCH:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
            step += 1 + max(steps(windows, step_tokens), default=0)
            kept = sorted({doc for _, doc, _ in left})
            held, moved = [held[d] for d in kept], {d: k for k, d in enumerate(kept)}
            pieces = [(length, moved[doc], start) for length, doc, start in left]
            tokens = sum(p[0] for p in pieces)

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                ids = encoder.encode(text)
                pieces.append((len(ids) // 4, len(held), 0))
                held.append((name, ids))
                tokens += len(ids) // 4
                if tokens >= run_tokens:
                    yield from flush(False)
        yield from flush(True)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32() if c == "tier" else pa.int64() for c in COLUMNS]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=COLUMNS)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(packed, SCHEMA)


def packed_stage(docs: DataFrame) -> DataFrame:
    return pack(docs, cached_words=FEWER_WORDS)
