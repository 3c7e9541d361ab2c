"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

A dynamic program over four states (nothing yet, after system, user, assistant) runs in NumPy, time-major: conversations
are bucketed by length, each turn updates the state costs of all conversations of a bucket at once, backward costs are
stored, and the edits of all of them are traced forward together. A conversation that is too long for one row goes in
segments: its turns are dealt over tasks by range, and only one byte a turn meets in the task that finds its edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common

#: Characters that are space.
SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits; a truncated turn that isn't deleted costs CUT more.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: A conversation of more turns, or more characters, than these goes in segments of so many turns.
LONG_TURNS, LONG_CHARS = 1024, 4_000_000
#: Cells (turns times conversations) of one bucket.
CELLS = 1 << 18
#: States are the role initial that came last: 0 nothing yet, 1 s, 2 u, 3 a. NEXT: where a user or assistant leads.
KINDS, NEXT = {"s": 1, "u": 2, "a": 3}, np.array([2, 2, 3, 2])
ROLES = {2: "user", 3: "assistant"}
#: What each state costs at the end: the inserts that complete it.
FINAL = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
FAR = np.int64(1) << 50


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault of each row after damage by crc32("conv_id:turn") % 20: 0 drops it (copies
    0), 1 empties the text, 2 takes its [.!?] out, 3 repeats the row (copies 2), 4 makes it the user's. Null roles and texts
    are one space, and so are null ids and turns in the hashed string. fault is blank, truncated or none, by the text alone."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).alias("copies"))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return rows.withColumn("fault", F.when(last == "", BLANK).when(last.isin(".", "!", "?"), NONE).otherwise(TRUNCATED))


# The dynamic program, time-major --------------------------------------------------------------------------------------


def backward(kind: np.ndarray, fault: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """costs[t, n, s]: the least cost from state s before turn t to the end of column n, whose end costs are end[n].
    kind and fault are [turns, columns]; a column's turns from length on don't count."""
    turns, columns = kind.shape
    costs = np.empty((turns + 1, columns, 4), dtype=np.int64)
    costs[turns] = end
    for t in range(turns - 1, -1, -1):
        costs[t] = np.where((t < length)[:, None], _inserted(_consumed(kind[t], fault[t], costs[t + 1]).min(axis=0)), costs[t + 1])
    return costs


def _consumed(kind: np.ndarray, fault: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs [3, columns, 4] of deleting, keeping and reroling a turn in each state."""
    moved = after[:, NEXT] + ((fault == TRUNCATED) * CUT)[:, None]
    free = ((fault != BLANK) & (fault != DUPLICATE))[:, None]
    keep = np.where(kind[:, None] == NEXT, moved, FAR)
    keep[:, 0] = np.where(kind == 1, after[:, 1] + (fault == TRUNCATED) * CUT, keep[:, 0])
    return np.stack([after + DELETE, np.where(free, keep, FAR), np.where(free, moved + REROLE, FAR)])


def _inserted(x: np.ndarray) -> np.ndarray:
    """State costs when inserts may come first; after two of them a user or assistant state is back where it was."""
    out = x.copy()
    out[:, 2] = np.minimum(x[:, 2], x[:, 3] + INSERT)
    out[:, 3] = np.minimum(x[:, 3], x[:, 2] + INSERT)
    out[:, :2] = np.minimum(x[:, :2], out[:, 2:3] + INSERT)
    return out


def traced(costs: np.ndarray, kind: np.ndarray, fault: np.ndarray, length: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """letters [turns + 1, columns, 3] (0: none) of the cheapest edits from the given states, and the states they end in.
    Of letters that cost the same the first in ASCII order is taken at each step: D, I, K, R. A column that is the last of
    its conversation is completed by inserts."""
    turns, columns = kind.shape
    letters, state, at = np.zeros((turns + 1, columns, 3), dtype=np.uint8), state.copy(), np.arange(columns)
    for t in range(turns):
        open_ = t < length
        delete, keep, rerole = _consumed(kind[t], fault[t], costs[t + 1])
        for slot in range(3):
            due = costs[t, at, state]
            d = open_ & (delete[at, state] == due)
            i = open_ & ~d & (costs[t, at, NEXT[state]] + INSERT == due)
            k = open_ & ~d & ~i & (keep[at, state] == due)
            r = open_ & ~d & ~i & ~k & (rerole[at, state] == due)
            letters[t, :, slot] = np.select([d, i, k, r], [68, 73, 75, 82], 0)
            state = np.where(k & (state == 0) & (kind[t] == 1), 1, np.where(i | k | r, NEXT[state], state))
            open_ = i
    for slot in range(2):
        i = last & ((state == 1) | (state == 2))
        letters[turns, :, slot] = np.where(i, 73, 0)
        state = np.where(i, NEXT[state], state)
    return letters, state


def repaired(codes: list[np.ndarray]) -> list[tuple[int, list[bytes]]]:
    """Cost and letters (those of each turn, and those after the last one) of conversations given as codes, a turn's kind
    plus four times its fault. Buckets hold lengths up to the same power of two."""
    size = np.array([len(c) for c in codes])
    out: list = [(0, [b""])] * len(codes)
    todo = np.flatnonzero(size)
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for b in np.unique(bucket[todo]):
        ids = todo[bucket[todo] == b]
        for part in np.array_split(ids, -(-len(ids) * (1 << b) // CELLS)):
            code = np.zeros((size[part].max(), len(part)), dtype=np.int8)
            for n, c in enumerate(part):
                code[: size[c], n] = codes[c]
            kind, fault, length = code & 3, code >> 2, size[part]
            costs = backward(kind, fault, length, np.broadcast_to(FINAL, (len(part), 4)))
            letters, _ = traced(costs, kind, fault, length, np.zeros(len(part), dtype=np.int64), np.ones(len(part), dtype=bool))
            for n, c in enumerate(part):
                rows = letters[: size[c], n].tobytes()
                out[c] = (int(costs[0, n, 0]), [rows[i : i + 3].rstrip(b"\0") for i in range(0, len(rows), 3)] + [letters[-1, n].tobytes().rstrip(b"\0")])
    return out


def repaired_long(code: np.ndarray, turns: int = LONG_TURNS) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """As repaired, for one conversation in columns of so many turns: cost, all letters, and where the letters of each turn
    end and the state before each turn. Each column's least costs between any two states come first, then those from its
    end on from the last column back, then the edits from each of four states, of which the column before picks one."""
    columns = -(-len(code) // turns)
    padded = np.zeros(columns * turns, dtype=np.int8)
    padded[: len(code)] = code
    padded, length = padded.reshape(columns, turns).T, np.full(columns, turns)
    length[-1] = len(code) - (columns - 1) * turns
    blocks = np.array_split(np.arange(columns), -(-columns * turns * 4 // CELLS))
    between = np.empty((columns, 4, 4), dtype=np.int64)  # column, first state, last state
    for b in blocks:
        for s in range(4):
            end = np.full((len(b), 4), FAR)
            end[:, s] = 0
            between[b, :, s] = backward(padded[:, b] & 3, padded[:, b] >> 2, length[b], end)[0]
    ends = np.empty((columns, 4), dtype=np.int64)
    ends[-1] = FINAL
    for c in range(columns - 1, 0, -1):
        ends[c - 1] = np.minimum((between[c] + ends[c]).min(axis=1), FAR)
    state, parts, per_turn, before = 0, [], [], []
    cost = int((between[0] + ends[0]).min(axis=1)[0])
    for b in blocks:
        kind, fault, long = (np.repeat(x, 4, axis=-1) for x in (padded[:, b] & 3, padded[:, b] >> 2, length[b]))
        last = np.repeat(b == columns - 1, 4)
        costs = backward(kind, fault, long, np.repeat(ends[b], 4, axis=0))
        letters, after = traced(costs, kind, fault, long, np.tile(np.arange(4), len(b)), last)
        for n, c in enumerate(b):
            own = letters[:, 4 * n + state]
            rows = np.concatenate([own[: length[c]], own[-1:]]) if c == columns - 1 else own[: length[c]]
            parts.append(rows[rows > 0].tobytes())
            per_turn.append((rows > 0).sum(axis=1))
            before.append((c, state))
            state = int(after[4 * n + state])
    return cost, b"".join(parts), np.cumsum(np.concatenate(per_turn)), _states(b"".join(parts), code)


def _states(audit: bytes, code: np.ndarray) -> np.ndarray:
    """The state after each letter."""
    out, state, row = np.empty(len(audit), dtype=np.int8), 0, 0
    for i, x in enumerate(audit):
        if x != 68:
            state = 1 if x == 75 and state == 0 and code[row] & 3 == 1 else int(NEXT[state])
        row += x != 73
        out[i] = state
    return out


def edited(letters: bytes, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """role:text lines of turns after the edits, and the state they end in."""
    lines, row = [], 0
    for x in letters:
        if x == 68:
            row += 1
            continue
        after = 1 if x == 75 and state == 0 and roles[row][:1] == "s" else int(NEXT[state])
        if x == 73:
            lines.append(f"{ROLES[after]}:")
        else:
            lines.append(f"{roles[row] if x == 75 else ROLES[after]}:{texts[row]}")
            row += 1
        state = after
    return lines, state


# Conversations of one row each ----------------------------------------------------------------------------------------

COUNTS = "blank long, duplicate long, truncated long, illegal long"
RESULT = f"conv_id %s, gaps long, {COUNTS}, cost long, audit string, repaired_sha256 string"


def counted(code: np.ndarray) -> list[int]:
    """blank, duplicate, truncated, and the neighbours whose initials aren't su, ua or au."""
    kind, fault = code & 3, code >> 2
    legal = np.isin(kind[:-1] * 4 + kind[1:], [1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2])
    return [int((fault == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)] + [int((~legal).sum())]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.lean()
    for batch in batches:
        lists = batch.column("rows")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        turn, role, text, copies, fault = (flat.field(i).to_pylist() for i in range(5))
        codes, kept, gaps = [], [], []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            rows = [i for i in range(lo, hi) for _ in range(copies[i])]
            seen: set = set()
            code = np.zeros(len(rows), dtype=np.int8)
            for n, i in enumerate(rows):
                again = (role[i], text[i]) in seen
                seen.add((role[i], text[i]))
                code[n] = KINDS.get(role[i][:1], 0) + 4 * (DUPLICATE if again and fault[i] != BLANK else fault[i])
            turns = {turn[i] for i in rows} - {None}
            gaps.append(max(turns) - min(turns) + 1 - len(turns) if turns else 0)
            codes.append(code)
            kept.append(rows)
        found = repaired(codes)
        digests = []
        for rows, (_, letters) in zip(kept, found, strict=True):
            lines, _ = edited(b"".join(letters), 0, [role[i] for i in rows], [text[i] for i in rows])
            digests.append(hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())
        counts = list(zip(*[counted(c) for c in codes], strict=True)) or [[]] * 4
        columns = [gaps, *map(list, counts), [c for c, _ in found], ["".join(x.decode() for x in letters) for _, letters in found], digests]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, pa.int64()) for c in columns[:6]], *[pa.array(c, pa.string()) for c in columns[6:]]], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


# Conversations in segments --------------------------------------------------------------------------------------------


def _segments(turns: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows of one range to segments of at most so many turns; what a frame leaves open the next one goes on with."""
        rest, number = None, 0
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf["conv_id"].astype("object").where(pdf["conv_id"].notna(), None)
            run_of = (key.ne(key.shift()) & ~(key.isna() & key.shift().isna())).cumsum()
            place = pdf.groupby(run_of).cumcount() // turns
            cuts = [g for _, g in pdf.groupby([run_of, place], sort=True)]
            rest = cuts.pop() if cuts else None
            for g in cuts:
                yield segment(g, number)
                number += 1
        if rest is not None and len(rest):
            yield segment(rest, number)

    def segment(g: pd.DataFrame, number: int) -> pd.DataFrame:
        code = g["role"].str[:1].map(KINDS).fillna(0).astype(np.int8).to_numpy() + 4 * g["fault"].to_numpy(dtype=np.int8)
        return pd.DataFrame({"conv_id": [g["conv_id"].iloc[0]], "part": [int(g["part"].iloc[0])], "number": [number], "codes": [code.astype(np.int8).tobytes()], "roles": [g["role"].tolist()], "texts": [g["text"].tolist()]})

    return run


def _edits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A conversation's segments of codes to its counts, cost and audit, and the letters and first state of each segment."""
    for pdf in frames:
        for conv, segments in zip(pdf["conv_id"], pdf["segments"], strict=True):
            parts = [np.frombuffer(s["codes"], dtype=np.int8) for s in segments]
            code = np.concatenate(parts)
            cost, audit, ends, states = repaired_long(code)
            rows = []
            lo = turn = 0
            for n, (s, p) in enumerate(zip(segments, parts, strict=True)):
                turn += len(p)
                hi = len(audit) if n == len(parts) - 1 else int(ends[turn - 1])
                rows.append({"part": s["part"], "number": s["number"], "state": int(states[lo - 1]) if lo else 0, "letters": audit[lo:hi].decode()})
                lo = hi
            yield pd.DataFrame({"conv_id": [conv], **{c: [x] for c, x in zip(("blank", "duplicate", "truncated", "illegal"), counted(code), strict=True)}, "cost": [cost], "audit": [audit.decode()], "edits": [rows]})


def _lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = [edited(x.encode(), s, list(r), list(t))[0] for x, s, r, t in zip(pdf["letters"], pdf["state"], pdf["roles"], pdf["texts"], strict=True)]
        yield pd.DataFrame({"conv_id": pdf["conv_id"], "part": pdf["part"], "number": pdf["number"], "lines": ["\n".join(x) if x else None for x in out]})


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations whose pieces come sorted; one piece at a time is in memory."""
    conv, sha, empty, begun = None, None, True, False
    for pdf in frames:
        done = []
        for c, piece in zip(pdf["conv_id"].astype("object").where(pdf["conv_id"].notna(), None), pdf["lines"], strict=True):
            if not begun or c != conv:
                if begun:
                    done.append((conv, sha.hexdigest()))
                conv, sha, empty, begun = c, hashlib.sha256(), True, True
            if piece is not None:
                sha.update((b"" if empty else b"\n") + piece.encode("utf-8", "surrogatepass"))
                empty = False
        yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"])
    if begun:
        yield pd.DataFrame([(conv, sha.hexdigest())], columns=["conv_id", "repaired_sha256"])


def _long(rows: DataFrame, kind: str, turns: int) -> DataFrame:
    """The results of long conversations. Equal rows are counted first; a text's first turn comes from an aggregation and is
    looked up by text and turn together; turns are dealt by range of all their columns. No step but the last, a digest that
    is a function of the whole conversation in order, puts the texts of one conversation in one task, and that one reads
    them piece by piece."""
    same = rows.groupBy("conv_id", "turn", "role", "text", "fault").agg(F.sum("copies").alias("copies")).where("copies > 0").withColumn("text_key", F.sha2("text", 256))
    same = common.materialize(same, "long-turns")
    firsts = same.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text_key").alias("k")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))["turn"].alias("t"), F.lit(True).alias("first"))
    marked = same.join(firsts, same["conv_id"].eqNullSafe(F.col("c")) & (same["role"] == F.col("r")) & (same["text_key"] == F.col("k")) & same["turn"].eqNullSafe(F.col("t")), "left")
    marked = marked.select("conv_id", "turn", "role", "text", "fault", F.coalesce("first", F.lit(False)).alias("first"), F.expr("explode(sequence(1L, copies))").alias("copy"))
    again = ~(F.col("first") & (F.col("copy") == 1)) & (F.col("fault") != BLANK)
    order = ["conv_id", "turn", "role", "text", "copy"]
    ranged = marked.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault"))).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("conv_id", "role", "text", "fault", F.spark_partition_id().alias("part"))
    segments = common.materialize(ranged.mapInPandas(_segments(turns), f"conv_id {kind}, part long, number long, codes binary, roles array<string>, texts array<string>"), "long-segments")
    codes = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "number", "codes"))).alias("segments"))
    edits = common.materialize(codes.mapInPandas(_edits, f"conv_id {kind}, {COUNTS}, cost long, audit string, edits array<struct<part:long,number:long,state:long,letters:string>>"), "long-edits")
    letters = edits.select(F.explode("edits").alias("e")).select("e.*")
    lines = segments.join(letters, ["part", "number"]).select("conv_id", "part", "number", "roles", "texts", "state", "letters").mapInPandas(_lines, f"conv_id {kind}, part long, number long, lines string")
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInPandas(_digests, f"conv_id {kind}, repaired_sha256 string")
    gaps = same.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    out = rows.groupBy("conv_id").agg(F.lit(1).alias("there"))
    for other in (gaps, edits.drop("edits"), digests):
        other = other.withColumnRenamed("conv_id", "__id")
        out = out.join(other, out["conv_id"].eqNullSafe(other["__id"]), "left").drop("__id")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(conversations: DataFrame, long_turns: int = LONG_TURNS, long_chars: int = LONG_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id, after damage.

    Turns of one number stand by role and text (bytes); rows with a null conv_id are one conversation; a role without s, u
    or a at its beginning, also an empty one, can't be kept. Texts may be of any length, repeated rows are duplicates, an
    empty table gives no rows, other columns aren't read. Results don't depend on long_turns and long_chars."""
    rows = damaged(conversations)
    kind = dict(conversations.dtypes)["conv_id"]
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(1))).alias("chars"))
    long = common.materialize(sizes.where((F.col("n") > long_turns) | (F.col("chars") > long_chars)).select(F.col("conv_id").alias("__id")), "long-conversations", narrow=True)
    some = long.limit(1).count() > 0
    named = lambda how: rows.join(common.small_or_not(long, 16), rows["conv_id"].eqNullSafe(F.col("__id")), how)
    short = named("left_anti") if some else rows
    grouped = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies", "fault"))).alias("rows"))
    out = grouped.mapInArrow(_whole, RESULT % kind)
    return out.unionByName(_long(common.materialize(named("left_semi"), "long-rows"), kind, long_turns)) if some else out


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(common.table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {
    "op11_conversation_repair": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), h AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))) % 20 AS harm FROM c
), d AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)
), n AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n
), g AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS turns FROM f GROUP BY conv_id
), st AS (
  SELECT conv_id, 0::BIGINT AS i, 'n' AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS x FROM g
  UNION ALL
  SELECT o.conv_id, o.i, o.state, min(o.x) FROM (
    SELECT f.conv_id, f.i, CASE WHEN e = 'D' THEN here WHEN e = 'K' THEN left(f.role, 1) WHEN here = 'u' THEN 'a' ELSE 'u' END AS state,
      {'cost': cost + CASE e WHEN 'D' THEN 3 ELSE CASE e WHEN 'R' THEN 2 ELSE 0 END + CASE fault WHEN 'truncated' THEN 1 ELSE 0 END END, 'audit': audit || e,
       'lines': CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, f.role || ':' || f.text) ELSE list_append(lines, CASE WHEN here = 'u' THEN 'assistant' ELSE 'user' END || ':' || f.text) END} AS x
    FROM (
      SELECT conv_id, i, CASE WHEN k = 0 THEN state WHEN (state = 'u') = (k = 1) THEN 'a' ELSE 'u' END AS here, x.cost + 2 * k AS cost, x.audit || repeat('I', k) AS audit,
        CASE WHEN k = 0 THEN x.lines WHEN state = 'u' THEN list_concat(x.lines, ['assistant:', 'user:'][:k]) ELSE list_concat(x.lines, ['user:', 'assistant:'][:k]) END AS lines
      FROM st, unnest([0, 1, 2]) AS t(k)
    ) p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1, unnest(['D', 'K', 'R']) AS t(e)
    WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR here || left(f.role, 1) IN ('ns', 'nu', 'su', 'ua', 'au'))
  ) o GROUP BY ALL
), z AS (
  SELECT st.conv_id, min({'cost': x.cost + CASE state WHEN 'u' THEN 2 WHEN 's' THEN 4 ELSE 0 END, 'audit': x.audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
    'lines': CASE state WHEN 'u' THEN list_append(x.lines, 'assistant:') WHEN 's' THEN list_concat(x.lines, ['user:', 'assistant:']) ELSE x.lines END}) AS x
  FROM st JOIN g ON g.conv_id IS NOT DISTINCT FROM st.conv_id AND st.i = g.turns GROUP BY ALL
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(x.cost, 0) AS BIGINT) AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(array_to_string(x.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
""",
}
