"""N-way merging of texts and of documents as lists of blocks: edits of several reviewers that don't touch each other
compose, equal ones count once, and the rest is a conflict that a policy settles."""

from __future__ import annotations

import bisect
import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import text as T
from quirelake.operators import align
from quirelake.sources.store import stored

POLICIES = ("baseWins", "firstReviewerWins", "stackAll")


# Edits of one text ----------------------------------------------------------------------------------------------------


def swept(base: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi, piece, inserts, deleters of the base texts (keys, text) cut at every end of an edit (keys, reviewer, lo,
    hi, text), in the order of reviewers.

    A reviewer's edits don't overlap, so the one that covers a piece is the last that began: a window for each reviewer, and
    no join of pieces with edits."""
    length = base.select(*keys, F.length("text").cast("long").alias("n"), "text")
    points = edits.select(*keys, F.explode(F.array("lo", "hi")).alias("lo")).unionByName(length.select(*keys, F.explode(F.array(F.lit(0).cast("long"), "n")).alias("lo"))).distinct()
    points = points.withColumn("hi", F.lead("lo").over(W.partitionBy(*keys).orderBy("lo")))
    wide = edits.where("hi > lo").select(*keys, "reviewer", "lo", F.struct(F.col("hi").alias("hi"), F.col("text").alias("text")).alias("cut"))
    seen = points.join(edits.select(*keys, "reviewer").distinct(), keys).join(wide, [*keys, "reviewer", "lo"], "left")
    last = F.last("cut", ignorenulls=True).over(W.partitionBy(*keys, "reviewer").orderBy("lo").rowsBetween(W.unboundedPreceding, 0))
    over = seen.withColumn("cut", last).where(F.col("cut.hi") > F.col("lo")).groupBy(*keys, "lo").agg(F.array_sort(F.collect_list(F.struct("reviewer", F.col("cut.text").alias("text"), (F.col("cut.hi") == F.col("hi")).alias("ends")))).alias("deleters"))
    new = edits.where("hi = lo").groupBy(*keys, "lo").agg(F.array_sort(F.collect_list(F.struct("reviewer", "text"))).alias("inserts"))
    out = points.join(over, [*keys, "lo"], "left").join(new, [*keys, "lo"], "left").join(length, keys)
    piece = F.when(F.col("hi").isNull(), "").otherwise(F.substr("text", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    return out.select(*keys, "lo", F.coalesce("hi", "lo").alias("hi"), piece.alias("piece"), "inserts", "deleters")


def composed(base: DataFrame, edits: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """keys, text, conflicts (how many pieces and places are contested) of each base text after all edits.

    At a place, equal inserts count once and different ones conflict; a piece that reviewers delete or replace alike goes
    once, with the first one's replacement after its last piece, else it conflicts. baseWins keeps the base at a conflict,
    firstReviewerWins takes the smallest reviewer's edit, stackAll deletes once and puts all texts in order of reviewers."""
    s = swept(base, edits, keys)
    several = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["text"]))) > 1
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    first = lambda c: F.slice(c, 1, 1)
    ended = lambda c: F.filter(c, lambda x: x["ends"])
    s = s.withColumns({"insert_conflict": F.coalesce(several("inserts"), F.lit(False)), "delete_conflict": F.coalesce(several("deleters"), F.lit(False))})
    won_in = {"baseWins": F.lit(""), "firstReviewerWins": texts(first("inserts")), "stackAll": texts("inserts")}[policy]
    won_out = {"baseWins": F.col("piece"), "firstReviewerWins": texts(ended(first("deleters"))), "stackAll": texts(ended("deleters"))}[policy]
    new = F.when(F.col("inserts").isNull(), "").when(F.col("insert_conflict"), won_in).otherwise(texts(first("inserts")))
    old = F.when(F.col("deleters").isNull(), F.col("piece")).when(F.col("delete_conflict"), won_out).otherwise(texts(ended(first("deleters"))))
    parts = F.array_sort(F.collect_list(F.struct("lo", F.concat(new, old).alias("text"))))
    return s.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.sum(F.col("insert_conflict").cast("long") + F.col("delete_conflict").cast("long")).alias("conflicts"))


# Kernels of one document ----------------------------------------------------------------------------------------------


def word_edits(left: list[str], right: list[str]) -> list[tuple[int, int, str]]:
    """(lo, hi, text): what turns left into right, texts given as tokens, as characters [lo, hi) of the left one and what
    replaces them. Words decide what stays; a word that differs in case only is replaced."""
    spans = [("Replace" if op == "Equal" and a != b else op, a, b) for op, a, b in align.diff_spans(left, right)]
    out, lo = [], 0
    for k, (op, a, b) in enumerate(spans):
        hi = lo + len(a)
        if op != "Equal" and not (op == "Insert" and k and spans[k - 1][0] == "Delete"):
            after = spans[k + 1] if k + 1 < len(spans) else ("", "", "")
            out.append((lo, hi, b if op != "Delete" else after[2] if after[0] == "Insert" else ""))
        lo = hi
    return out


def pieces(text: str, edits: list[tuple]) -> list[tuple[int, int, str, list, list]]:
    """(lo, hi, piece, inserts, deleters) of swept for one text and its edits (reviewer, lo, hi, text)."""
    points = sorted({0, len(text), *(x for _, lo, hi, _ in edits for x in (lo, hi))})
    inserts: dict[int, list] = {}
    wide: dict = {}
    for reviewer, lo, hi, new in sorted(edits):
        if hi == lo:
            inserts.setdefault(lo, []).append((reviewer, new))
        else:
            wide.setdefault(reviewer, []).append((lo, hi, new))
    deleters: dict[int, list] = {}
    for reviewer, cuts in wide.items():
        for lo, hi, new in cuts:
            a, b = bisect.bisect_left(points, lo), bisect.bisect_left(points, hi)
            for k in range(a, b):
                deleters.setdefault(points[k], []).append((reviewer, new, k + 1 == b))
    return [(lo, hi, text[lo:hi], inserts.get(lo, []), deleters.get(lo, [])) for lo, hi in zip(points, [*points[1:], points[-1]], strict=True)]


def settled(text: str, edits: list[tuple], policy: str) -> tuple[str, int]:
    """The text of composed for one text, and how many conflicts it has."""
    out, conflicts = [], 0
    several = lambda x: len({new for _, new, *_ in x}) > 1
    for _, _, piece, inserts, deleters in pieces(text, edits):
        ended = lambda x: [new for _, new, ends in x if ends]
        if inserts:
            take = {"baseWins": [], "firstReviewerWins": inserts[:1], "stackAll": inserts}[policy] if several(inserts) else inserts[:1]
            conflicts += several(inserts)
            out += [new for _, new in take]
        if not deleters:
            out.append(piece)
        elif several(deleters):
            conflicts += 1
            out += {"baseWins": [piece], "firstReviewerWins": ended(deleters[:1]), "stackAll": ended(deleters)}[policy]
        else:
            out += ended(deleters[:1])
    return "".join(out), conflicts


def review(base: tuple[list, list, list], version: tuple[list, list, list]) -> list[tuple]:
    """(op, left_ord, right_ord, text, after) of the script from base to a reviewer's version, equal blocks left out; both are
    (ords, texts, hashes). after: the base block (also a deleted one) that stands last before an insert or the new place of a
    move, -1 for none. Modified blocks of equal text are equal."""
    out, last = [], -1
    for op, i, j in align.block_script(base[1], base[2], version[1], version[2]):
        here = last
        if op in ("Equal", "Modify", "Delete"):
            last = base[0][i]
        if op == "Equal" or (op == "Modify" and base[1][i] is not None and base[1][i] == version[1][j]):
            continue
        out.append((op, None if i is None else base[0][i], None if j is None else version[0][j], None if j is None else version[1][j], here))
    return out


def consolidate(base: tuple[list, list, list], versions: dict, policy: str) -> list[tuple[str, str]]:
    """(text, status) of the blocks of consolidated for one document; versions by reviewer."""
    edits: dict[int, list] = {}
    new: dict[tuple, list] = {}
    for reviewer in sorted(versions):
        for op, lo, ro, text, after in review(base, versions[reviewer]):
            if lo is None:
                new.setdefault((after, text), []).append((reviewer, ro))
            else:
                edits.setdefault(lo, []).append((reviewer, op, text, after, ro))
    out = []
    for lo, text in zip(base[0], base[1], strict=True):
        own = edits.get(lo, [])
        moves = [x for x in own if x[1] in ("Move", "MoveModify")]
        kinds = {(f"Move{x[3]}" if x in moves else x[1], x[2] or "") for x in own}
        status = "equal" if not own else "single" if len(own) == 1 else "consensus" if len(kinds) == 1 else "composed" if all(x[1] == "Modify" for x in own) else "contestedMove" if len(moves) == len(own) else "conflict"
        changed = [x[2] for x in own if x[1] == "Modify"]
        first = [x[2] for x in own[:1] if x[1] == "Modify"]
        if status == "equal":
            stays = [text]
        elif status == "composed":
            tokens = T.token_list(text)
            told, conflicts = settled(text, [(x[0], *e) for x in own for e in word_edits(tokens, T.token_list(x[2]))], policy)
            stays, status = [told], "conflict" if conflicts else status
        elif status == "conflict":
            stays = {"baseWins": [text], "firstReviewerWins": first, "stackAll": list(dict.fromkeys(changed)) or [text]}[policy]
        elif status == "contestedMove":
            stays = [text] if policy == "baseWins" else []
        else:
            stays = first
        out += [(lo, 0, 0, 0, p, t, status) for p, t in enumerate(stays)]
        taken = own[:1] if status in ("single", "consensus") else {"baseWins": [], "firstReviewerWins": own[:1], "stackAll": own}[policy] if status == "contestedMove" else []
        out += [(x[3], 1, 1, x[0], x[4], x[2], status) for x in taken if x in moves]
    for (after, text), who in new.items():
        reviewer, ro = min(who)
        out.append((after, 2, 1, reviewer, ro, text, "consensus" if len({r for r, _ in who}) > 1 else "single"))
    # the base has no reviewer and stands first; of one reviewer's moves to one place the order is that of the version
    return [(x[5], x[6]) for x in sorted(out, key=lambda x: (x[:2], x[2:5] if x[2] else (0,), x[4]))]


def contested_words(base: tuple[list, list, list], versions: dict) -> list[tuple]:
    """(left_ord, lo, hi, reviewer, text): every competitor of every conflict of words in one document."""
    found: dict[int, list] = {}
    for reviewer in sorted(versions):
        for op, lo, _, text, _ in review(base, versions[reviewer]):
            if op == "Modify":
                found.setdefault(lo, []).append((reviewer, text))
    out = []
    for ord_, text in zip(base[0], base[1], strict=True):
        if len(found.get(ord_, ())) > 1:
            tokens = T.token_list(text)
            edits = [(reviewer, *e) for reviewer, new in found[ord_] for e in word_edits(tokens, T.token_list(new))]
            for lo, hi, _, inserts, deleters in pieces(text, edits):
                for until, rows in ((lo, inserts), (hi, deleters)):
                    if len({x[1] for x in rows}) > 1:
                        out += [(ord_, lo, until, x[0], x[1]) for x in rows]
    return out


# Documents ------------------------------------------------------------------------------------------------------------


def by_document(base: DataFrame, versions: DataFrame, kernel, columns: str, key: str = "doc_id") -> DataFrame:
    """key and columns: what kernel(base, versions by reviewer) gives for each document; each version is (ords, texts,
    hashes) in order. A document and its versions are one row, dealt by key once; where both are dealt by it already, nothing
    is shuffled, and no text leaves the row but those of the result."""
    names = ("ord", "text", "hash")
    one = lambda df, name, more: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*more, *names))).alias(name))
    both = one(base, "b", []).join(one(versions, "v", ["reviewer"]).withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "full")
    both = both.select(F.coalesce(key, "__key").alias(key), *[F.coalesce(f"{x}.{n}", F.array()).alias(f"{x}_{n}") for x, more in (("b", ()), ("v", ("reviewer",))) for n in (*more, *names)])
    fields = [c.split()[0] for c in columns.split(", ")]

    def run(frames):
        for pdf in frames:
            rows = []
            for k, *b, who, vo, vt, vh in pdf.itertuples(index=False, name=None):
                ends = [0, *(i for i in range(1, len(who)) if who[i] != who[i - 1]), len(who)]
                own = {who[i]: (vo[i:j].tolist(), list(vt[i:j]), list(vh[i:j])) for i, j in itertools.pairwise(ends) if j > i}
                rows += [(k, *x) for x in kernel((list(map(int, b[0])), list(b[1]), list(b[2])), own)]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=[key, *fields])
                    rows = []
            yield pd.DataFrame(rows, columns=[key, *fields])

    return both.mapInPandas(run, f"{key} {dict(base.dtypes)[key]}, {columns}")


def consolidated(base: DataFrame, versions: DataFrame, policy: str, key: str = "doc_id") -> DataFrame:
    """key, ord, text, status of one document from a base and its reviewers' versions.

    A base block that nobody touches stays (equal), one toucher's edit is taken (single), equal edits once (consensus), and
    edits of its words compose (composed, conflict if any word is contested). Blocks that several move to different places
    are contested moves: the base place wins, the first place, or all of them. Any other mix is a conflict of whole blocks:
    base, the first reviewer's edit, or all different texts in order. New blocks stand after the base block that they
    follow, in order of reviewers; those that are equal and follow the same block count once."""
    merge = lambda b, v: [(ord_, *x) for ord_, x in enumerate(consolidate(b, v, policy))]
    return stored(by_document(base, versions, merge, "ord long, text string, status string", key), "word-edits")
