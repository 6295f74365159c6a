"""Token ids in flat files of unsigned integers, with 64-bit document offsets, for memory mapping.

A dataset is a folder of parts. Part p holds documents of one range of ids, in ascending order:
  part-p-a.bin   ids, little-endian, unsigned 16-bit if the vocabulary fits, else unsigned 32-bit
  part-p-a.idx   signed 64-bit offsets, one more than documents: where each document's ids start in the part
  part-p-a.ids   signed 64-bit document ids (NO_ID for null)
Parts follow each other in ascending order; a part's base is the number of ids in all parts before it, a
prefix sum over one row a part. Every attempt a of a task writes files of its own, and the list of parts, which is
written last (parts.json), names those of the attempts that counted: nothing is renamed or overwritten, and a lost
executor leaves files that no list names.

Defined results: a null text is empty and holds the end id only; null document ids come first; documents that share an
id are ordered by a hash of their texts, and spread over parts by it; repeated rows are documents of their own; an empty table gives no parts; other columns don't matter.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import file_system, scratch_path, session, utf8
from .tokens import Encoder, default_path, vocabulary_size

NO_ID = np.iinfo(np.int64).min
#: Documents read at a time from a part.
READ_DOCS = 2048


Part = tuple[int, int, int, int]  # number, attempt, documents, ids


def part_name(folder: str, part: int, attempt: int, kind: str) -> str:
    return f"{folder}/part-{part:06d}-{attempt}.{kind}"


def write(docs: DataFrame, folder: str, tokenizer: str | None = None) -> list[Part]:
    """Writes the dataset; its parts that have documents, in order."""
    path = tokenizer or default_path()
    width = "<u2" if vocabulary_size(path) <= 1 << 16 else "<u4"
    fs, inner = file_system(folder)
    fs.create_dir(inner, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = Encoder.at(path), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, inner = file_system(folder)
        out, end, docs = None, 0, 0
        for batch in batches:
            if batch.num_rows and out is None:
                out = {kind: fs.open_output_stream(part_name(inner, part, attempt, kind)) for kind in ("bin", "idx", "ids")}
                out["idx"].write(np.zeros(1, "<i8").tobytes())
            ends = np.empty(batch.num_rows, "<i8")
            for k, text in enumerate(utf8(batch.column("text"))):
                ids = np.frombuffer(encoder.encode(text), "<u4")
                out["bin"].write(ids.astype(width).tobytes())
                end += len(ids)
                ends[k] = end
            if batch.num_rows:
                out["idx"].write(ends.tobytes())
                out["ids"].write(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                docs += batch.num_rows
        if out:
            for stream in out.values():
                stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "attempt": [attempt], "docs": [docs], "ids": [end]})

    order = ["doc_id", "hash"]
    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "text", "xxhash64(text) as hash")
    stored = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(store, "part long, attempt long, docs long, ids long")
    parts = sorted(tuple(r) for r in stored.collect())
    with fs.open_output_stream(f"{inner}/parts.json") as out:
        out.write(json.dumps({"width": width, "parts": parts}).encode())
    return parts


def listed(folder: str) -> tuple[list[Part], str]:
    """(parts, width) of a dataset that was written before."""
    fs, inner = file_system(folder)
    with fs.open_input_stream(f"{inner}/parts.json") as read:
        found = json.loads(read.read())
    return [tuple(p) for p in found["parts"]], found["width"]


def opened(folder: str, part: int, attempt: int, kind: str):
    """A file of the dataset, memory-mapped where the store is mounted."""
    from pyarrow import fs as stores

    fs, inner = file_system(folder)
    name = part_name(inner, part, attempt, kind)
    return pa.memory_map(name) if isinstance(fs, stores.LocalFileSystem) else fs.open_input_file(name)


def documents_of(folder: str, part: int, attempt: int, width: str, step: int = READ_DOCS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, offsets in the part, ids) of step documents at a time."""
    with opened(folder, part, attempt, "ids") as names, opened(folder, part, attempt, "idx") as offsets, opened(folder, part, attempt, "bin") as ids:
        size = np.dtype(width).itemsize
        for first in range(0, names.size() // 8, step):
            doc = np.frombuffer(names.read_at(min(8 * step, names.size() - 8 * first), 8 * first), "<i8")
            at = np.frombuffer(offsets.read_at(8 * (len(doc) + 1), 8 * first), "<i8")
            yield doc, at, np.frombuffer(ids.read_at(size * int(at[-1] - at[0]), size * int(at[0])), width)


def read(spark: SparkSession, folder: str, parts: list[Part], width: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)
    names = [p[:2] for p in parts]
    bases = [0, *accumulate(p[3] for p in parts)][: len(parts)]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            for doc, at, ids in documents_of(folder, *names[k], width):
                wide, cuts = ids.astype("<u4"), at - at[0]
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, mask=doc == NO_ID), "start": at[:-1] + bases[k], "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())})

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(load, schema)


def round_trip(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes docs to folder, by default a new one in the shared scratch folder, and reads it back."""
    spark = session(docs)
    folder = folder or scratch_path(spark, "token-files")
    write(docs, folder, tokenizer)
    return read(spark, folder, *listed(folder))
