"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the largest permitted length; pieces are dealt into groups of bounded size, and
each group is packed and written out as sequences by one task."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common

#: Permitted sequence lengths, in words.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: A sequence costs its length plus this many words of fixed cost.
OVERHEAD = 32
#: Bytes of text that one packing task gets, about.
GROUP_BYTES = 12 * 1024 * 1024

SPACE = "[\\x20\\x09-\\x0D]+"


def pieces(docs: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """Cut each document into pieces of at most the largest capacity: row, doc_id, piece, start, length (in words), text
    (the piece's words, one space between them). row tells rows of docs apart.

    A null, empty or blank text has no piece."""
    most = max(capacities)
    cut = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "").alias("words"))
    cut = cut.where(F.size("words") > 0).select("row", "doc_id", "words", F.explode(F.expr(f"sequence(0, (size(words) - 1) div {most})")).alias("piece"))
    part = F.slice("words", F.col("piece") * most + 1, F.lit(most))
    cut = cut.select("row", "doc_id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * most).cast("long").alias("start"), part.alias("words"))
    return cut.select("row", "doc_id", "piece", "start", F.size("words").cast("long").alias("length"), F.array_join("words", " ").alias("text"))


def opening(length: int, capacities: Sequence[int], overhead: int, small: np.ndarray) -> int:
    """The capacity with the least cost for a piece that fits no open bin.

    Cost: capacity + overhead, less the room left over as far as pieces still to come can fill it: small[r] is the
    share of the remaining pieces' words in pieces of at most r words, the same for all capacities."""
    best, least = 0, float("inf")
    for c in capacities:
        if c >= length:
            room = c - length
            cost = (c + overhead - room * small[min(room, len(small) - 1)]) / length
            if cost < least:
                best, least = c, cost
    return best


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack lengths (each at most the largest capacity), given in decreasing order.

    Returns for each piece its bin, its offset in the bin, and for each bin its final capacity: the smallest permitted
    one that holds its contents. The open bins are a sorted list of (room, bin), so the tightest is found by bisection."""
    capacities = sorted(capacities)
    most = capacities[-1]
    words = np.bincount(lengths, weights=lengths, minlength=most + 1)
    left = words.copy()
    rooms: list[tuple[int, int]] = []
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    small, stale = np.cumsum(left) / max(1.0, left.sum()), 0
    for i, n in enumerate(lengths.tolist()):
        left[n] -= n
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            if stale <= 0:
                small, stale = np.cumsum(left) / max(1.0, left.sum()), 256
            stale -= 1
            room, b = opening(n, capacities, overhead, small), len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    final = np.array([capacities[bisect_left(capacities, u)] for u in used], dtype=np.int64)
    return bins, offsets, final


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per sequence: bin_id, capacity (words), used, padding (capacity - used), text (its words, one space between
    them), and, in the order of the text, for each piece its doc_id, piece number, start in the document, offset in the
    sequence and length: doc_ids, pieces, starts, offsets, lengths. A document's pieces, joined in order, are its words.

    Pieces are dealt by a hash of row and piece number into as many groups as keep each at about group_bytes, so no key,
    null or repeated id is hot and no task gets an unbounded group; each group is packed by itself. Of equally long pieces
    the one with the smaller doc_id (as text), then piece number, then row comes first. Repeated rows are packed as often
    as they occur; a very long text is cut into many pieces; null, empty and blank texts give none; an empty table gives no
    rows. Extra columns are ignored."""
    groups = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes))
    cut = pieces(docs, capacities).withColumn("doc_id", F.col("doc_id").cast("string"))
    cut = cut.withColumn("pack_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    caps = tuple(capacities)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        common.lean()
        pdf = pdf.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, final = best_fit(pdf["length"].to_numpy(np.int64), caps, overhead)
        by = np.lexsort((offsets, bins))
        cuts = np.searchsorted(bins[by], np.arange(len(final) + 1))
        columns = {"doc_ids": pdf["doc_id"], "pieces": pdf["piece"], "starts": pdf["start"], "offsets": offsets, "lengths": pdf["length"], "text": pdf["text"]}
        columns = {k: np.asarray(v)[by] for k, v in columns.items()}
        out = {k: [v[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for k, v in columns.items()}
        used = np.bincount(bins, weights=pdf["length"], minlength=len(final)).astype(np.int64)
        group = int(pdf["pack_group"].iloc[0])
        return pd.DataFrame({"bin_id": (group << 32) + np.arange(len(final)), "capacity": final, "used": used, "padding": final - used} | out | {"text": [" ".join(t) for t in out["text"]]})

    kind = dict(docs.dtypes)["doc_id"]
    out = cut.groupBy("pack_group").applyInPandas(run, "bin_id long, capacity long, used long, padding long, doc_ids array<string>, pieces array<long>, starts array<long>, offsets array<long>, lengths array<long>, text string")
    return out.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{kind}>"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
