"""Validation of a document's history: transactions, and undo and redo of them, from a source to what was delivered.

A history is told step by step to a small stack machine, whose state can be kept between batches of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMMITTED = ("committed", "partiallyCommitted")
#: Columns of a step: entry is the transaction's id, for undo and redo that of the one they affect.
STEP = ("seq", "action", "entry", "before_version", "before_digest", "after_version", "after_digest", "succeeded")
STATE = "next long, version long, digest string, entries array<string>, befores array<string>, afters array<string>, undo array<long>, redo array<long>, finding string"


class History:
    """The state after some steps; finding is the first breach, after which nothing is looked at any more."""

    def __init__(self, version: int, digest: str):
        self.next, self.version, self.digest, self.finding = 0, version, digest, None
        self.transactions: list[tuple[str, str, str]] = []
        self.known: dict[str, int] = {}
        self.undo: list[int] = []
        self.redo: list[int] = []

    def step(self, seq, action, entry, before_version, before_digest, after_version, after_digest, succeeded) -> None:
        if self.finding:
            return
        self.finding = self._breach(seq, action, entry, (before_version, before_digest), (after_version, after_digest), succeeded)
        self.next += 1

    def _breach(self, seq, action, entry, before, after, succeeded) -> str | None:
        if seq != self.next:
            return "sequence"
        transaction = action not in ("undo", "redo")
        if before != (self.version, self.digest):
            return "transactionGap" if transaction else "lineageGap"
        if transaction:
            if action == "failed":
                return "failedChanged" if after != before else None
            if action == "prediction":
                # a prediction is nothing that happened: it must say what would have changed, one version on
                return "prediction" if after != before and (after[1] == before[1] or after[0] != before[0] + 1 or not succeeded) else None
            if action not in COMMITTED:
                return "status"
            if after == before:
                return None
            if after[0] != before[0] + 1:
                return "transactionVersion"
            if entry in self.known:
                return "entryRepeated"
            self.known[entry] = len(self.transactions)
            self.undo.append(len(self.transactions))
            self.transactions.append((entry, before[1], after[1]))
            self.redo.clear()
        else:
            if after[0] != before[0] + 1:
                return "lineageVersion"
            if entry not in self.known:
                return "target"
            at = self.known[entry]
            stack, other, content = (self.undo, self.redo, self.transactions[at][1]) if action == "undo" else (self.redo, self.undo, self.transactions[at][2])
            if not stack or stack[-1] != at:
                return f"{action}Order"
            if after[1] != content:
                return "content"
            other.append(stack.pop())
        self.version, self.digest = after
        return None

    def delivered(self, version, digest) -> str | None:
        return self.finding or ("delivered" if (self.version, self.digest) != (version, digest) else None)

    def saved(self) -> tuple:
        columns = list(zip(*self.transactions, strict=True)) or [(), (), ()]
        return (self.next, self.version, self.digest, *map(list, columns), self.undo, self.redo, self.finding)

    @classmethod
    def loaded(cls, state: tuple) -> History:
        h = cls(state[1], state[2])
        h.next, h.undo, h.redo, h.finding = state[0], list(state[6]), list(state[7]), state[8]
        h.transactions = list(zip(*state[3:6], strict=True))
        h.known = {t[0]: i for i, t in enumerate(h.transactions)}
        return h


def findings(log: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """key, valid, finding (null if valid) of histories: log has key and the columns of STEP, documents the key with
    source_version, source_digest, delivered_version and delivered_digest. Steps are told in order of seq, ties by action
    and entry, and a repeated or missing number is a breach. A history travels as one row in Arrow batches."""
    steps = log.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*STEP))).alias("steps"))
    both = documents.join(steps, key, "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for row in pdf.itertuples(index=False):
                h = History(row.source_version, row.source_digest)
                for s in row.steps if row.steps is not None else ():
                    h.step(*[s[c] for c in STEP])
                found.append(h.delivered(row.delivered_version, row.delivered_digest))
            yield pd.DataFrame({key: pdf[key], "valid": [f is None for f in found], "finding": found})

    return both.select(key, "source_version", "source_digest", "delivered_version", "delivered_digest", "steps").mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, valid boolean, finding string")


def watched(log: DataFrame, key: str) -> DataFrame:
    """key, seq, finding of a stream of steps: the first breach of each history, once. The first step says what the source
    is. A history's state is its stack and the contents that undo and redo must restore."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("seq")
        h = History.loaded(state.get) if state.exists else History(int(pdf["before_version"].iloc[0]), pdf["before_digest"].iloc[0])
        out = []
        for row in pdf[list(STEP)].itertuples(index=False, name=None):
            clean = h.finding is None
            h.step(*[int(x) if c in ("seq", "before_version", "after_version") else x for c, x in zip(STEP, row, strict=True)])
            if clean and h.finding:
                out.append((k[0], int(row[0]), h.finding))
        state.update(h.saved())
        yield pd.DataFrame(out, columns=[key, "seq", "finding"])

    return log.groupBy(key).applyInPandasWithState(run, f"{key} {dict(log.dtypes)[key]}, seq long, finding string", STATE, "append", GroupStateTimeout.NoTimeout)
