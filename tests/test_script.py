"""Edit scripts of all kinds: kernels against brute force, and both versions of fuzzed revisions."""

import itertools
import random

from pyspark.sql import functions as F

from quirelake.operators import script


def blocks(spark, docs):
    rows = [(d, o, t) for d, texts in docs.items() for o, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, ord long, text string").withColumn("hash", F.sha2("text", 256))


def test_best_chain_brute():
    r = random.Random(1)
    for _ in range(300):
        found = []
        for _ in range(r.randint(0, 9)):
            a, c = r.randint(0, 5), r.randint(0, 5)
            found.append((a, a + r.choice([0, 0, 1, 2]), c, c + r.choice([0, 0, 1, 2]), r.randint(1, 9)))
        fits = lambda chain: all(x[1] < y[0] and x[3] < y[2] for x, y in itertools.pairwise(chain))
        most = max(sum(x[4] for x in c) for n in range(len(found) + 1) for c in itertools.combinations(sorted(found), n) if fits(c))
        chain = script.best_chain(found)
        assert fits(chain) and sum(x[4] for x in chain) == most


def told(cells, side):
    other, out, open_ = "Deleted" if side == "right" else "Inserted", [], ""
    for c in cells:
        open_ += c[side]
        if c["mark"] != other:
            out.append(open_)
            open_ = ""
    assert open_ == ""
    return out


def test_crossed_cells():
    """A run's cells give both versions, whatever moved; words that stay in their block make no run."""
    cut = lambda texts: [[x for w in t.split(" ") for x in (" ", w)][1:] for t in texts]
    left, right = ["one two three four five", "six seven eight nine ten"], ["one two three", "four five six seven eight nine ten"]
    cells = script.crossed(cut(left), cut(right))
    assert [c["mark"] for c in cells] == ["Inserted", "Deleted", "Equal"] and told(cells, "left") == left and told(cells, "right") == right
    assert script.crossed(cut(left), cut([t + " more" for t in left])) is None
    r = random.Random(2)
    for _ in range(300):
        k = r.randint(2, 4)
        a, b = ([" ".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(k)] for _ in range(2))
        cells = script.crossed(cut(a), cut(b))
        assert cells is None or (told(cells, "left") == a and told(cells, "right") == b)


def revised(r, texts):
    out = list(texts)
    for _ in range(r.randint(1, 5)):
        i = r.randrange(len(out)) if out else 0
        kind = r.choice(["split", "merge", "shift", "delete", "insert", "edit", "move", "change", "repeat"])
        w = out[i].split(" ") if out else []
        if kind == "split" and len(w) > 5:
            out[i : i + 1] = [" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])]
        elif kind == "merge" and i + 1 < len(out):
            out[i : i + 2] = [out[i] + " " + out[i + 1]]
        elif kind == "shift" and i + 1 < len(out) and len(w) > 4:
            out[i : i + 2] = [" ".join(w[:-2]), " ".join(w[-2:]) + " " + out[i + 1]]
        elif kind == "delete" and out:
            del out[i]
        elif kind == "insert":
            out.insert(i, r.choice(["", "brand new text", "x"]))
        elif kind == "edit" and out:
            out[i] += " edited"
        elif kind == "move" and out:
            out.insert(r.randrange(len(out)), out.pop(i))
        elif kind == "change" and out:
            out.insert(r.randrange(len(out)), out.pop(i) + " changed")
        elif kind == "repeat" and out:
            out.insert(i, out[i])
    return out


def test_fuzzed_versions(spark):
    r = random.Random(4)
    old = {d: [" ".join(r.choices([f"w{i}" for i in range(r.choice([6, 400]))], k=r.choice([0, 1, 6, 15, 30]))) for _ in range(r.choice([1, 3, 10]))] for d in range(90)}
    new = {d: revised(r, texts) or ["only"] for d, texts in old.items()}
    s = script.full_script(blocks(spark, old), blocks(spark, new)).cache()
    for side, want in (("left", old), ("right", new)):
        got = {}
        for row in script.version(s, side).orderBy("doc_id", "ord").collect():
            got.setdefault(row["doc_id"], []).append(row["text"])
        assert got == want
    ops = {row["op"] for row in s.select("op").distinct().collect()}
    assert ops == {"Equal", "Modify", "Insert", "Delete", "Move", "MoveModify", "Split", "Merge", "CrossParagraphRun"}
    seqs = s.groupBy("doc_id").agg((F.max("seq") + 1 == F.count_distinct("seq")).alias("ok")).where("not ok").count()
    assert seqs == 0


def test_formats_and_empty(spark):
    a = blocks(spark, {1: ["one two", "three"]}).withColumn("format", F.lit("plain"))
    b = a.withColumn("format", F.when(F.col("ord") == 0, "bold").otherwise("plain"))
    assert [r["op"] for r in script.full_script(a, b).orderBy("seq").collect()] == ["FormatOnly", "Equal"]
    assert script.full_script(a.limit(0), b.limit(0)).count() == 0


def test_runs_that_hold_too_few_words_are_not_counted(monkeypatch):
    """Many equal lines: each may be a part of each other by itself, but no run of two of them fits in one."""
    made = []

    class Counted(script.Counter):
        def __init__(self, *args):
            made.append(1)
            super().__init__(*args)

    monkeypatch.setattr(script, "Counter", Counted)
    lines = [["one", "line", "of", "many", "words"]] * 60
    assert script.runs(lines, lines) == [] and len(made) < 60
    whole, parts = [["a", "b", "c", "d", "e", "f"], ["x", "y"]], [["q", "r"], ["a", "b", "c"], ["d", "e", "f"], ["x", "y"]]
    assert script.runs(whole, parts) == [(0, 1, 2, 5997)]


def test_places_need_no_texts(spark):
    old = {1: ["a b c d e f g h i j k l", "m n o p", "q r s t"], 2: ["same", "gone now", "x y z w"]}
    new = {1: ["a b c d e f", "g h i j k l", "q r s t"], 2: ["x y z w", "same", "new one"]}
    left, right = blocks(spark, old), blocks(spark, new)
    columns = ["doc_id", "seq", "op", "left_ords", "right_ords", "cells"]
    places = script.full_script(left, right, texts=False)
    assert places.columns == columns and "REPARTITION_BY_COL" not in places._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, places.collect())) == sorted(map(repr, script.full_script(left, right).select(*columns).collect()))
    told = {(r["doc_id"], i): t for r in script.full_script(left, right).collect() for i, t in zip(r["left_ords"], r["left_texts"], strict=True)}
    assert told == {(d, i): t for d, texts in old.items() for i, t in enumerate(texts)}


def test_words_cross_where_a_tie_would_hide_them():
    """The first moved word and the first of the next block are the same: matched within its block, it hid the others."""
    left, right = [["a", "b", "c", "same", "d", "e"], ["same", "f", "g", "h"]], [["a", "b", "c"], ["same", "d", "e", "same", "f", "g", "h"]]
    cells = script.crossed(left, right)
    assert cells and told(cells, "left") == ["".join(b) for b in left] and told(cells, "right") == ["".join(b) for b in right]


def test_heaviest_brute(monkeypatch):
    r = random.Random(5)
    for _ in range(400):
        monkeypatch.setattr(script, "KEPT_CELLS", r.choice([1, 20, 1_000_000]))
        left, right = ([r.choices(["a", "bb", "ccc", "d"], k=r.randint(0, 6)) for _ in range(r.randint(3, 3))] for _ in range(2))
        flat = [[(k, w) for k, block in enumerate(side) for w in block] for side in (left, right)]
        best = [[(0, 0)] * (len(flat[1]) + 1) for _ in range(len(flat[0]) + 1)]
        for i, j in itertools.product(reversed(range(len(flat[0]))), reversed(range(len(flat[1])))):
            (k, v), (m, w), (own, over) = flat[0][i], flat[1][j], best[i + 1][j + 1]
            best[i][j] = max(best[i + 1][j], best[i][j + 1], ((own + len(w), over) if k == m else (own, over + len(w))) if v == w else (0, 0))
        found = script.heaviest(left, right)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(found)) and all(flat[0][p][1] == flat[1][q][1] for p, q in found)
        size = lambda same: sum(len(flat[0][p][1]) for p, q in found if (flat[0][p][0] == flat[1][q][0]) == same)  # noqa: E731,B023
        assert (size(True), size(False)) == best[0][0]


def test_blocks_of_any_length_may_cross():
    """A table of more than a million cells was not made, and its run of blocks stayed modifications."""
    words = [f"w{i}" for i in range(2_400)]
    cut = lambda blocks: [[x for w in block for x in (w, " ")] for block in blocks]
    left, right = cut([words[:1_200], words[1_200:]]), cut([words[:1_190], words[1_190:]])
    found = script.gap_operations(["".join(b) for b in left], ["".join(b) for b in right], left, right)
    assert [x["op"] for x in found] == ["CrossParagraphRun"]
    assert told(found[0]["cells"], "right") == ["".join(b) for b in right]
