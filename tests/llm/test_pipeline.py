"""The pipeline's stages take effect, keep clean documents and the columns of documents."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    syl = ["ba", "ke", "lo", "mi", "tu", "ran", "sel", "der"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = {i: "\n".join(text(30) for _ in range(4)) for i in range(80)}
    rows = [(i, t, "en", f"s{i % 20}", len(t)) for i, t in clean.items()]
    rows = [(i, "Click here to accept\n" + t if i < 40 else t, *r) for i, t, *r in rows]
    edited = clean[50].split(" ")
    edited[20] = "changed"
    rows += [(200, clean[50], "en", "s1", 0), (201, " ".join(edited), "en", "s2", 0), (202, "too short", "en", "s1", 0), (203, None, None, None, None), (204, "a b c d e " * 20, "en", "s3", 0)]
    item = text(25)
    rows += [(205, clean[60] + "\n" + text(30) + " " + item + " " + text(20), "en", "s4", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == columns
            left.append({r["doc_id"] for r in docs.collect()})
            if name == "line_dedup":
                assert sum(r["text"].count("Click here") for r in docs.collect()) == 1
    assert set(range(80)) <= left[-1] and left[0] & {202, 203, 204} == set()
    assert {200, 201} <= left[1] and left[2] & {200, 201} == set() and 205 in left[2] and 205 not in left[3]
    assert {i for r in docs.collect() for i in r["doc_ids"]} == left[-1]


def test_line_dedup_keeps_own_text(spark, docs):
    """A document that is mostly boilerplate lines keeps the rest; only one without another word goes."""
    shared = "all rights reserved by the owner of this site and by nobody else"
    rows = [(i, f"{shared}\nown words of {i}", "en", f"s{i}") for i in range(20)] + [(20, shared, "en", "s1"), (21, None, "en", "s2"), (22, "", "en", "s3")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs(rows), "").collect()}
    assert got == {0: rows[0][1], **{i: f"own words of {i}" for i in range(1, 20)}, 21: None, 22: ""}


def test_near_duplicates_go_by_text(spark, docs):
    """A copy with a null doc_id doesn't take the other texts without an id along, nor does a repeated doc_id."""
    rnd = random.Random(5)
    a, b, c, d, e = (" ".join(f"{t}{rnd.randrange(10**6)}" for _ in range(60)) for t in "abcde")
    rows = [(1, a), (None, a), (None, b), (5, c), (5, c), (5, d), (6, c), (7, e), (7, e + " more"), (8, d), (9, None), (9, "")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs(rows), "").collect()]
    kept_e = [t for i, t in got if i == 7]
    assert len(kept_e) == 1 and kept_e[0] in (e, e + " more")
    assert sorted(map(repr, (r for r in got if r[0] != 7))) == sorted(map(repr, [(1, a), (None, b), (5, c), (5, d), (9, None), (9, "")]))


def test_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, columns with clashing names; an empty table."""
    rnd = random.Random(3)
    syl = ["ba", "ke", "lo", "mi", "tu", "ran", "sel", "der"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, one, two = text(25), text(120), text(120)
    rows = [(i, text(120), "en", f"s{i % 20}", "a", "b") for i in range(60)]
    rows += [(None, one, "en", "s1", "a", "b"), (None, two, "en", "s1", "a", "b"), (None, text(60) + " " + item, "en", "s1", "a", "b"), (None, "few words", "en", None, "a", "b"), (7, one + " more", None, "s1", "a", "b"), (None, None, None, None, None, None)]
    rows += [(2**53 + 1, text(150), "en", "s1", "a", "b"), (2**53 + 3, text(150), "en", "s1", "a", "b")]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_removed string, kept string")
    full.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == full.columns
    got = docs.collect()
    assert {2**53 + 1, 2**53 + 3, *range(60)} <= {r["doc_id"] for r in got} and {r["n_removed"] for r in got} == {"a"}
    assert {r["text"] for r in got if r["doc_id"] is None} <= {one, two} and any(r["text"] == two for r in got)
    none = full.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
