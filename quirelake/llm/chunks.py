"""Requests and answers between chunks of a corpus and shards of a key space.

A statistic over all keys of a corpus (n-grams, substrings) is too large for one machine, yet a document needs only the
few entries that it touches. Documents are therefore packed into chunks of a few MB; a chunk asks every shard of the key
space for its own distinct keys, sorted and packed into one binary value per (chunk, shard); a shard sees the requests of
all chunks, computes, and answers in the order of each request. Nothing is broadcast and nothing reaches the driver;
chunks, shards and answers are bounded by parameters, and every step is a deterministic function of stored tables, so
lost executors only repeat work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import common

CHUNK_BYTES = 4 * 1024 * 1024
#: Stands for a null id, so that no batch of ids ever turns into floats.
NO_ID = 2**63 - 1

CHUNK = "chunk long, size long, meta binary, blob binary, note binary"
REQUEST = "shard int, kind int, chunk long, body binary, extra binary"
ANSWER = "chunk long, shard int, kind int, body binary"


def squeeze(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences, byte plane by byte plane."""
    d = np.diff(keys, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: those of small numbers are empty but one."""
    return squeeze(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T))


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def shard_bounds(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) for each shard that has some of the sorted keys."""
    if not len(keys):
        return []
    of = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(of, prepend=of[:1] + np.uint64(1)))
    ends = np.append(starts[1:], len(keys))
    return [(int(of[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


def chunked(docs: DataFrame, name: str, chunk_bytes: int = CHUNK_BYTES, flag: str | None = None, note: Callable[[np.ndarray, bytes], bytes] | None = None) -> DataFrame:
    """docs (doc_id, text) as a table of chunks: chunk, meta (ids, byte lengths, and 1 where the column flag is true),
    blob, and note(start offsets, bytes) for later use. Null texts are empty, a null doc_id is NO_ID; other columns are
    left behind. A longer document has a chunk of its own."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        ids, texts, flags, size, n = [], [], [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def done() -> pd.DataFrame:
            nonlocal ids, texts, flags, size, n
            meta, raw = np.array([ids, [len(t) for t in texts], flags], dtype=np.int64), b"".join(texts)
            more = note(np.concatenate([[0], np.cumsum(meta[1])]), raw) if note else b""
            out = pd.DataFrame({"chunk": [first + n], "size": [len(raw)], "meta": [meta.tobytes()], "blob": [zstandard.ZstdCompressor(level=3).compress(raw)], "note": [more]})
            ids, texts, flags, size, n = [], [], [], 0, n + 1
            return out

        for pdf in it:
            for i, t, f in zip(pdf["doc_id"], pdf["text"], pdf["flag"], strict=True):
                ids.append(i)
                flags.append(int(f))
                texts.append(common.text_bytes(t))
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield done()
        if ids:
            yield done()

    return common.materialize(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", (F.coalesce(flag, F.lit(False)) if flag else F.lit(False)).alias("flag")).mapInPandas(run, CHUNK), name)


def open_chunk(meta: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """ids, start offsets (with the end of the last), bytes."""
    m = np.frombuffer(meta, np.int64).reshape(3, -1)
    return m[0], np.concatenate([[0], np.cumsum(m[1])]), expand(blob)


def flags_of(meta: bytes) -> np.ndarray:
    return np.frombuffer(meta, np.int64).reshape(3, -1)[2] > 0


def whole_ids(docs: DataFrame) -> None:
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be a whole number, not {kind}")


def ids_out(ids: np.ndarray):
    """ids as a column, NO_ID as null."""
    return pd.Series([None if i == NO_ID else i for i in ids.tolist()], dtype="Int64") if (ids == NO_ID).any() else ids


def ask(chunks: DataFrame, requests: Callable[[pd.Series], Iterator[tuple[int, int, bytes, bytes]]]) -> DataFrame:
    """requests(row of the table of chunks) gives (shard, kind, body, extra); one row for each."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for pdf in it:
            for row in pdf.itertuples():
                yield _rows(row.chunk, requests(row))

    return chunks.mapInPandas(run, REQUEST)


def _rows(chunk: int, found: Iterator[tuple[int, int, bytes, bytes]]) -> pd.DataFrame:
    rows = list(found)
    return pd.DataFrame({"shard": [r[0] for r in rows], "kind": [r[1] for r in rows], "chunk": chunk, "body": [r[2] for r in rows], "extra": [r[3] for r in rows]})


def answer(requests: DataFrame, reply: Callable[[int, pd.DataFrame], Iterator[tuple[int, bytes]]], name: str) -> DataFrame:
    """reply(kind, requests of one shard and kind) gives (chunk, body); a stored table of answers. Rows with a negative
    chunk are a shard's own findings."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        common.lean()
        rows = list(reply(int(key[1]), pdf))
        return pd.DataFrame({"chunk": [r[0] for r in rows], "shard": key[0], "kind": key[1], "body": [r[1] for r in rows]})

    return common.materialize(requests.groupBy("shard", "kind").applyInPandas(run, ANSWER), name)


def meet(chunks: DataFrame, answers: DataFrame, run: Callable[[pd.Series, dict[int, list[bytes]]], pd.DataFrame], schema: str) -> DataFrame:
    """run(row of the table of chunks, answers by kind in shard order) for each chunk."""

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        common.lean()
        if not len(left):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        by = {int(k): list(x.sort_values("shard")["body"]) for k, x in right.groupby("kind")}
        return run(left.iloc[0], by)

    return chunks.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInPandas(one, schema)


def shards_for(docs_bytes: int, shard_bytes: int) -> int:
    return max(1, -(-docs_bytes // shard_bytes))


def raw_bytes(chunks: DataFrame) -> int:
    """Bytes of the texts of all stored chunks."""
    return chunks.agg(F.sum("size")).first()[0] or 0
