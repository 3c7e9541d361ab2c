"""Work that grows no faster than its input, and results that don't depend on the input's size."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import align, compose, delta, export, layout, package, runs, script, sheet, structure
from quirelake.plans import q_blocks, q_compose, q_runs
from quirelake.sources.store import stored
from quirelake.sources.tables import blocks, revised


def test_occurrences_read_a_long_text_once(spark):
    long = "ab aba " * 60_000 + "x\U0001f600\\E.aaaa"
    rows = [(1, long, "b ab"), (2, long, "x\U0001f600\\E."), (3, long, "aaa"), (4, "aaa", "aa"), (5, "aaa", ""), (6, None, "a"), (7, "b", "bb"), (8, "a.b", ".")]
    began = time.time()
    got = {r["k"]: r["at"] for r in spark.createDataFrame(rows, "k int, t string, n string").select("k", T.occurrences(F.col("t"), F.col("n"), 3).alias("at")).collect()}
    n = len("ab aba ") * 60_000
    assert got == {1: [1, 8, 15], 2: [n], 3: [n + 5, n + 6], 4: [0, 1], 5: [], 6: [], 7: [], 8: [1]}
    assert time.time() - began < 20


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_not_broadcast_for_small_files(spark):
    table = stored(spark.range(100_000).select("id", (F.col("id") % 3).alias("x")), "small-file")
    for kind in ("inner", "left", "left_semi", "left_anti"):
        assert "Broadcast" not in plan(spark.range(10).select("id", F.lit("a").alias("y")).join(table.where("x > 0"), "id", kind))


def test_similarities_of_blocks_without_a_row_for_each_pair(spark):
    r = random.Random(7)
    texts = lambda: [" ".join(["the", "of", "and", *(f"w{r.randint(0, 40)}" for _ in range(r.randint(0, 5))), "the"]) for _ in range(400)] + ["", "- - -", "one two"]
    a, b = texts(), texts()
    frame = lambda t: spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "doc_id long, ord long, text string")
    words = lambda t: [x for x in t.split(" ") if x.strip("-")]

    def brute(numbered, least, least_words):
        bag = (lambda t: Counter(words(t))) if numbered else (lambda t: Counter(set(words(t))))
        out = {}
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                both = (bag(x) & bag(y)).total()
                score = round(both / max(1, bag(x).total() + bag(y).total() - both), 6)
                if both and score >= least and min(len(words(x)), len(words(y))) >= least_words:
                    out[i, j] = score
        return out

    got = lambda df: {(x["left_ord"], x["right_ord"]): x["score"] for x in df.collect()}
    sets, bags = align.set_similarity(frame(a), frame(b), least=0.5), align.bag_similarity(frame(a), frame(b), least=0.35)
    assert got(sets) == brute(False, 0.5, 3) and got(bags) == brute(True, 0.35, 1)
    assert "word" not in " ".join(x for x in plan(sets).split("\n") if "Join" in x)


def test_splits_of_many_small_documents_go_in_batches(spark):
    rows = [(d, 0, "a b c d e f g h i j k l") for d in range(50)]
    parts = [(d, o, t) for d in range(50) for o, t in enumerate(["x y z", "a b c d e f", "", "g h i j k l"] if d % 2 else ["a b c d e f", "g h i j k l"])]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, ord long, text string")
    found = layout.splits(frame(rows), frame(parts))
    assert {tuple(x) for x in found.collect()} == {(d, 0, d % 2, 3 if d % 2 else 1) for d in range(50)}
    assert "CoGroup" not in plan(found)


def test_word_edits_are_found_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(compose, "stored", lambda df, name: calls.append(name) or stored(df, name))
    base = spark.createDataFrame([(1, 0, "a b c d e f", "h")], "doc_id long, ord long, text string, hash string")
    versions = spark.createDataFrame([(1, n, 0, t, f"h{n}") for n, t in ((1, "x b c d e f"), (2, "a b c d e y"))], "doc_id long, reviewer int, ord long, text string, hash string")
    out = compose.consolidated(base, versions, "baseWins").collect()
    assert [(x["text"], x["status"]) for x in out] == [("x b c d e y", "composed")] and "word-edits" in calls


def test_runs_are_cut_in_rows_of_a_block(spark):
    r = spark.createDataFrame([(1, 0, "ab"), (1, 1, None), (1, 2, ""), (1, 3, "cd\U0001f600"), (1, 4, "ef"), (2, 0, "xy")], "b long, run int, text string")
    m = spark.createDataFrame([(1, 1, 3, "<1>"), (1, 3, 4, None), (1, 5, 99, "<2>"), (1, 6, 6, "empty")], "b long, start long, end long, replacement string")
    out, cut = runs.replaced(r, m, ["b"]), runs.fragments(r, m, ["b"])
    assert {(x["b"], x["run"]): x["text"] for x in out.collect()} == {(1, 0): "a<1>", (1, 1): None, (1, 2): "", (1, 3): "\U0001f600", (1, 4): "<2>", (2, 0): "xy"}
    assert sorted(tuple(x)[1:] for x in cut.collect()) == [(1, 3, 0, 1, 2, "b"), (1, 3, 3, 0, 1, "c"), (3, 4, 3, 1, 2, "d"), (5, 99, 4, 0, 2, "ef")]
    assert "Window" not in plan(out) + plan(cut)


def test_equal_blocks_are_no_part_of_a_run_that_crosses():
    left = ["same words stand here", "one two three four five six seven", "eight nine ten eleven twelve more", "same words stand here"]
    right = [left[0], "one two three four", "five six seven eight nine ten eleven twelve more", left[3]]
    cut = lambda side: [re.findall(r"\w+|\W", t) for t in side]
    got = [(x["op"], x["left"], x["right"]) for x in script.gap_operations(left, right, cut(left), cut(right))]
    assert got == [("Modify", [0], [0]), ("CrossParagraphRun", [1, 2], [1, 2]), ("Modify", [3], [3])]


def test_packages_meet_once_not_in_rounds(spark, monkeypatch):
    old = [(1, "r", "k", "1"), (1, "a", "k", "2"), (1, "b", "k", None), (1, "gone", "k", "4"), (1, None, "k", "5"), (2, "r", "k", "1"), (None, "r", "k", "1"), (None, "a", "k", "1"), (3, "b", "k", "1")]
    links = [(1, "r", "x", "a"), (1, "a", "y", "b"), (1, "a", None, "none"), (1, "r", "z", "gone"), (1, "stray", "z", "b"), (1, "b", "n", None), (2, "r", "x", "a"), (None, "r", "x", "a")]
    new = [*old[:2], (1, "b", "k", "changed"), (1, "moved", "k", "4"), *old[4:8], (4, "b", "k", "1")]
    frames = lambda parts, relations: (spark.createDataFrame(parts, "package long, part string, kind string, content string"), spark.createDataFrame(relations, "package long, source string, name string, target string"))
    versions = frames(old, links), frames(new, [*links[:3], (1, "r", "z", "moved"), *links[4:]])
    rows = lambda df: sorted(map(repr, df.collect()))
    with monkeypatch.context() as m:
        m.setattr(package, "merkle", None)
        whole = rows(package.package_changes(*versions))
    assert len(whole) == 12 and {"Row(package=1, part='b', change='modified', kind='k')", "Row(package=1, part='moved', change='renamed', kind='k')", "Row(package=3, part='b', change='removed', kind='k')", "Row(package=None, part='r', change='added', kind='k')"} <= set(whole)
    chain = frames([(1, f"p{i}", "k", "x") for i in range(66)], [(1, f"p{i}", "n", f"p{i + 1}") for i in range(65)])
    with pytest.raises(Exception, match="cycle"):
        package.compared(chain, chain)[0].count()


def test_large_packages_go_by_rounds_with_the_same_result(spark, monkeypatch):
    parts = [(1, "r", "k", "1"), (1, "a", "k", "2"), (2, "r", "k", "3")]
    frames = lambda parts, relations: (spark.createDataFrame(parts, "package long, part string, kind string, content string").coalesce(1), spark.createDataFrame(relations, "package long, source string, name string, target string").coalesce(1))
    versions = frames(parts, [(1, "r", "x", "a")]), frames([parts[0], (1, "a", "k", "3"), (2, "r", "k", "4")], [(1, "r", "x", "a")])
    rows = lambda found: [sorted(map(repr, df.collect())) for df in found]
    whole = rows(package.compared(*versions, differing=True))
    monkeypatch.setattr(package, "LARGE", 4)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(package.compared(*versions, differing=True)) == whole and list(map(len, whole)) == [3, 1, 1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_scripts_join_texts_of_changes_only(spark):
    texts = ["one two three four\nx y z\nsame words are here\nthe same again and again\nlast one here moves", "a\nb", None]
    left = blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    right = revised(left)
    assert "Union" not in plan(right)
    script = align.edit_script(left, right)
    got = [(x["op"], x["left_ord"], x["right_ord"], x["left_text"], x["right_text"]) for x in script.where("doc_id = 0").orderBy("seq").collect()]
    t = texts[0].split("\n")
    assert got == [("Move", 4, 0, t[4], t[4]), ("Equal", 0, 1, t[0], t[0]), ("Delete", 1, None, t[1], None), ("Modify", 2, 2, t[2], t[2] + " edited here"), ("Equal", 3, 3, t[3], t[3]), ("Insert", None, 4, None, "appended block of 0")]
    read = lambda df: {re.search(r"/([a-z-]+)-[0-9a-f]{32}/", f)[1] for f in df.inputFiles()}
    assert "left-blocks" in read(script) and not read(script.where("op <> 'Equal'")) & {"left-blocks", "right-blocks"}


def test_foreign_words_are_found_once_for_a_part(spark, sf):
    lines = plan(q_blocks.split_merge_candidates(spark, sf)).split("\n")
    assert any("array_except" in x for x in lines) and not any("array_except" in x and "lambdafunction(NOT" in x for x in lines)


def test_notes_are_aligned_by_rows_of_bits(spark):
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        assert structure.common_places(a, b) == structure.longest_common(a, b)
    a, b = ([str(r.randrange(4000)) for _ in range(8000)] for _ in range(2))
    began = time.time()
    assert len(structure.common_places(a, b)) > 100 and time.time() - began < 5  # 64 million cells
    frame = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (None, 0, "b"), (2, 0, "c")], "doc_id long, ord long, text string")
    found = structure.note_pairs(frame, frame)
    assert "FlatMapGroups" not in plan(found)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 0, 0), (1, 1, 1), (2, 0, 0), (None, 0, 0)]


def test_words_of_a_long_block_are_placed_once(spark):
    t = spark.createDataFrame([(1, "ab " * 150_000), (2, " \t"), (3, None), (4, "x" * 90 + " y\r\nz")], "doc_id long, text string")
    began = time.time()
    placed = export.token_layout(t, ["doc_id"])
    got = {r["doc_id"]: (r["n"], r["last"], r["x"], r["y"]) for r in placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("nth").alias("last"), F.max("x").alias("x"), F.max("y").alias("y")).collect()}
    assert got == {1: (150_000, 149_999, 522.0, 72.0 + 12 * (150_000 // 26)), 4: (3, 2, 84.0, 84.0)}
    assert time.time() - began < 20


def test_documents_are_dealt_to_tasks_before_they_are_cut(spark):
    b = blocks(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b\nc 1.5, d").alias("text")).coalesce(1))
    assert plan(b).count("Exchange hashpartitioning(doc_id") == 1
    assert plan(revised(b)).count("Exchange hashpartitioning(doc_id") == 1  # its windows need no other


def test_words_and_tokens_are_split(spark):
    x = F.col("text")
    rows = [("Ab, 1.5-2,5 (c)\nd.", ["Ab", ",", " ", "1.5", "-", "2,5", " ", "(", "c", ")", "\nd", "."]), ("", []), (".", ["."]), ("\u00a0x\uff0cy ", [" ", "x", "\uff0c", "y", " "]), (None, None)]
    t = spark.createDataFrame(rows, "text string, want array<string>").select("*", T.tokens(x).alias("got"), T.words(x).alias("words"))
    assert "regexp_extract_all" not in plan(t)
    for r in t.collect():
        assert r["got"] == r["want"] and r["words"] == (None if r["want"] is None else [w.lower() for w in r["want"] if w not in " ,.-()\uff0c"])


def test_marks_between_digits_are_hidden_only_where_there_are_any(spark):
    """Of a text without them nothing is made but its pieces; odd texts of each kind are cut alike."""
    assert str(T.words(F.col("text"))).count("regexp_replace") == 2
    rows = [("Ab,c. D", ["ab", "c", "d"]), ("ΣΑΣ.Β Ä", ["σας", "β", "ä"]), ("1.5 2,x 3. 4", ["1.5", "2", "x", "3", "4"]), ("A\ue000 \ue000 B", ["a.", "b"]), ("..", []), ("", []), (None, None)]
    got = spark.createDataFrame(rows, "text string, want array<string>").select("want", T.words(F.col("text")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_interrupted_words_are_found_in_one_row_of_a_text(spark):
    rows = [("t", 0, "word", "a", 0, 1), ("t", 1, "atom", "^", 1, 1), ("t", 2, "atom", None, 1, 1), ("t", 3, "word", "b", 1, 2), ("t", 4, "atom", "#", 2, 2), ("t", 5, "word", "c", 2, 3), ("t", 6, "atom", "~", 3, 3), ("t", 8, "word", "d", 3, 4), ("u", 9, "word", "e", 4, 5), ("u", 10, "atom", "%", None, None), ("u", 11, "word", "f", 5, 6)]
    t = spark.createDataFrame(rows, "by string, ord long, kind string, key string, start long, end long")
    found = structure.interrupted(t, ["by"])
    assert plan(found).count("Exchange hashpartitioning") == 1
    m = structure.INTERRUPTION
    assert {r["ord"]: r["match_key"] for r in found.collect()} == {0: f"a{m}^", 1: "^", 2: None, 3: f"b{m}^{m}#", 4: "#", 5: f"c{m}#", 6: "~", 8: "d", 9: "e", 10: "%", 11: "f"}


def test_cells_of_a_grid_are_not_sorted_by_windows(spark):
    r = random.Random(9)
    rows = [(t, i, p, r.randint(1, 2), r.choice(["restart", "continue", None])) for t in "ab" for i in r.sample(range(9), 6) for p in range(3)]
    found = sheet.grid(spark.createDataFrame(rows, "t string, row long, pos long, span long, v_merge string"), ["t"])
    assert not re.search(r"\bWindow\b|\bSort\b", plan(found))
    want = {}
    for t, i, p, n, m in sorted(rows, key=lambda x: x[:3]):
        start = sum(x[3] for x in rows if x[:2] == (t, i) and x[2] < p)
        above = [x[1] for x in want.values() if x[0] == t and x[2] == start and x[3] != "continue"]
        want[t, i, p] = (t, i, start, m, max(above) if m == "continue" and above else i)
    assert {(x["t"], x["row"], x["pos"]): (x["t"], x["row"], x["grid_start"], x["v_merge"], x["covering_row"]) for x in found.collect()} == want


def test_digests_meet_as_bytes(spark):
    rows = lambda *x: spark.createDataFrame(x, "k int, v string")
    found = delta.delta(rows((1, "a"), (2, "b"), (3, None)), rows((2, "c"), (3, None), (4, "d")), ["k"], ["v"])
    assert plan(found).count("unhex(sha2(") == 2
    got = {r["k"]: r for r in found.collect()}
    assert {k: r["change"] for k, r in got.items()} == {1: "Removed", 2: "Modified", 3: "Same", 4: "Added"}
    assert got[1]["old_digest"] == hashlib.sha256(b'{"v":"a"}').hexdigest() and got[1]["new_digest"] is None


def test_table_rows_are_shuffled_once(spark):
    frame = lambda rows: spark.createDataFrame(rows, "t string, row long, cells array<string>")
    old = frame([("a", 1, ["x"]), ("a", 2, ["y"]), ("a", 3, ["z"]), ("a", 4, ["p", "1"]), ("a", 5, ["d"]), ("a", 6, ["d"]), ("b", 1, ["only"])])
    new = frame([("a", 1, ["y"]), ("a", 2, ["x"]), ("a", 3, ["z"]), ("a", 4, ["p", "2"]), ("a", 5, ["d"])])
    found = layout.table_diff(old, new, ["t"])
    assert plan(found).count("Exchange hashpartitioning") == 1
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) >= {("a", 1, 2, "Equal", None), ("a", 2, 1, "Moved", None), ("a", 3, 3, "Equal", None), ("a", 4, 4, "Modified", "1"), ("a", 5, 5, "Equal", None), ("a", 6, None, "Deleted", None), ("b", 1, None, "Deleted", None)}


def test_versions_of_a_script_need_no_shuffle_behind_its_texts(spark):
    left = blocks(spark.createDataFrame([(i, "a b c d\nb c\n\nx y z") for i in range(3)] + [(9, None)], "doc_id long, text string"))
    s = script.full_script(left, revised(left))
    digest = script.version(s, "right").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("blocks"))
    assert plan(digest).split("REPARTITION_BY_COL")[0].count("Exchange") == 1
    want = {r["doc_id"]: [tuple(b) for b in r["blocks"]] for r in revised(left).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("blocks")).collect()}
    assert {r["doc_id"]: [tuple(b) for b in r["blocks"]] for r in digest.collect()} == want


def test_tokens_in_python_are_those_of_spark(spark):
    r = random.Random(7)
    texts = ["", "1.5,2 a.b", " x", "A ΣαΣ b", "(x-y)\n z;，w", *("".join(r.choices(" -)(;,:.、ab1 2 É\n", k=r.randint(0, 12))) for _ in range(300))]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, t string")
    for i, a, b in t.select("i", T.tokens(F.col("t")), T.words(F.col("t"))).collect():
        assert T.token_list(texts[i]) == a and T.word_list(texts[i]) == b, texts[i]


def test_block_script_is_the_edit_script(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choices([f"w{i}" for i in range(r.choice([5, 40]))], k=r.choice([0, 1, 3, 6, 12])))
    old = {d: [text() for _ in range(r.choice([1, 4, 9]))] for d in range(60)}
    new = {}
    for d, texts in old.items():
        out = [x + " more" if r.random() < 0.3 else x for x in texts if r.random() < 0.8] + [text()]
        new[d] = r.sample(out, len(out)) if d % 3 == 0 else out
    frame = lambda docs: spark.createDataFrame([(d, o, t) for d, texts in docs.items() for o, t in enumerate(texts)], "doc_id long, ord long, text string").withColumn("hash", F.sha2("text", 256))
    want: dict = {}
    for x in align.edit_script(frame(old), frame(new)).orderBy("doc_id", "seq").collect():
        want.setdefault(x["doc_id"], []).append((x["op"], x["left_ord"], x["right_ord"]))
    assert {d: align.block_script(old[d], old[d], new[d], new[d]) for d in old} == want


def test_consolidation_shuffles_a_document_once(spark, sf):
    out = q_compose._versions(spark, sf)
    found = compose.by_document(*out, compose.contested_words, "left_ord long, lo long, hi long, reviewer int, text string")
    found.collect()
    done = [x for x in plan(found).split("Initial Plan")[0].split("\n") if "Exchange" in x and "Reused" not in x]
    assert len(done) == 1, done


def test_runs_of_a_block_are_never_rows_to_be_sorted(spark, sf):
    """A block's runs and matches stay in its row: they were cut apart and sorted together again, which spilled."""
    for query in (q_runs.run_fragments, q_runs.run_replacements):
        steps = plan(query(spark, sf))
        assert steps.count("Exchange") == 1 and not any(x in steps for x in ("Sort", "Join", "Aggregate")), steps
