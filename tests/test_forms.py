"""Runs, normal forms of XML, package graphs, composition and histories on small odd tables."""

import pytest
from pyspark.sql import functions as F

from quirelake.operators import compose, lineage, package, runs, xmlform


def test_runs_odd(spark):
    r = spark.createDataFrame([(1, 0, "ab", "x"), (1, 1, None, "y"), (1, 2, "", "z"), (1, 3, "cde", "w"), (2, 0, "zz", "x")], "doc_id long, run int, text string, format string")
    m = spark.createDataFrame([(1, 1, 3, "-"), (1, 3, 4, "+"), (1, 4, 4, "never")], "doc_id long, start int, end int, replacement string")
    got = [tuple(x)[1:] for x in runs.fragments(r, m, ["doc_id"]).orderBy("start", "run").collect()]
    assert got == [(1, 3, 0, 1, 2, "b"), (1, 3, 3, 0, 1, "c"), (3, 4, 3, 1, 2, "d")]
    out = {(x["doc_id"], x["run"]): (x["text"], x["format"]) for x in runs.replaced(r, m, ["doc_id"]).collect()}
    assert out == {(1, 0): ("a-", "x"), (1, 1): (None, "y"), (1, 2): ("", "z"), (1, 3): ("+e", "w"), (2, 0): ("zz", "x")}


def test_xml_forms():
    d = lambda x: xmlform.digest(x, {("a", "k"): "d"})
    same = ["<a b='1' c='2'>t<e/></a>", "<?xml version='1.0'?><a c='2' b='1'>t<!-- x --><e></e>\n</a>", "<a b='1' c='2' k='d'>&#116;<e/> </a>"]
    assert len({d(x) for x in same}) == 1
    other = ["<a b='1' c='3'>t<e/></a>", "<a b='1' c='2'>T<e/></a>", "<a b='1' c='2'><e/>t</a>", "<a xmlns='u' b='1' c='2'>t<e/></a>", "<a b='1' c='2' k='x'>t<e/></a>", "<a b='1' c='2' xml:space='preserve'>t<e/> </a>"]
    assert len({d(x)[0] for x in [*same, *other]}) == 1 + len(other)
    assert d(None) == (None, "null") and d("<a>")[0] is None and d("<!DOCTYPE a><a/>") == (None, "document type") and d("<a>" * 300 + "</a>" * 300)[1] == "too deep"


def graph(spark, parts, relations):
    return spark.createDataFrame([(1, *p) for p in parts], "package long, part string, kind string, content string"), spark.createDataFrame([(1, *r) for r in relations], "package long, source string, name string, target string")


def test_package_graphs(spark):
    old = graph(spark, [("r", "k", "1"), ("a", "k", "2"), ("b", "k", None), ("gone", "k", "4"), ("under", "k", "5")], [("r", "x", "a"), ("a", "y", "b"), ("r", "z", "gone"), ("gone", "w", "under"), ("r", "m", "missing")])
    new = graph(spark, [("r", "k", "1"), ("a", "k", "2"), ("b", "k", "changed")], [("r", "x", "a"), ("a", "y", "b"), ("r", "m", "missing")])
    got = {tuple(x)[1:3] for x in package.package_changes(old, new).collect()}
    assert got == {("b", "modified"), ("gone", "removed"), ("r#z", "relationRemoved")}
    assert package.package_changes(old, old).count() == 0
    cycle = graph(spark, [("a", "k", "1"), ("b", "k", "2")], [("a", "x", "b"), ("b", "x", "a")])
    with pytest.raises(ValueError, match="cycle"):
        old_depth, package.DEEPEST = package.DEEPEST, 3
        try:
            package.merkle(*cycle).count()
        finally:
            package.DEEPEST = old_depth


def merged(spark, edits, policy, text="one two three"):
    base = spark.createDataFrame([(1, text)], "id long, text string")
    table = spark.createDataFrame([(1, *e) for e in edits], "id long, reviewer int, lo long, hi long, text string")
    return tuple(compose.composed(base, table, ["id"], policy).first())[1:]


def test_composition(spark):
    apart = [(1, 0, 3, "ONE"), (2, 8, 13, ""), (2, 7, 7, "!"), (3, 7, 7, "!")]
    assert {merged(spark, apart, p) for p in compose.POLICIES} == {("ONE two! ", 0)}
    over = [(1, 4, 7, "x"), (2, 4, 13, "y")]
    # the piece that both take is contested, the rest of the longer one is only the second's
    assert merged(spark, over, "baseWins") == ("one twoy", 1) and merged(spark, over, "firstReviewerWins") == ("one xy", 1) and merged(spark, over, "stackAll") == ("one xy", 1)
    insert = [(2, 3, 3, "b"), (1, 3, 3, "a")]
    assert [merged(spark, insert, p)[0] for p in compose.POLICIES] == ["one two three", "onea two three", "oneab two three"]


def test_history_resumes():
    steps = [(0, "committed", "a", 0, "s", 1, "x", True), (1, "undo", "a", 1, "x", 2, "s", True), (2, "redo", "a", 2, "s", 3, "x", True), (3, "committed", "b", 3, "x", 4, "y", True)]
    whole, parts = lineage.History(0, "s"), lineage.History(0, "s")
    for s in steps:
        whole.step(*s)
        parts = lineage.History.loaded(parts.saved())
        parts.step(*s)
    assert whole.saved() == parts.saved() and whole.delivered(4, "y") is None and whole.delivered(4, "x") == "delivered"
    whole.step(4, "redo", "a", 4, "y", 5, "x", True)
    assert whole.finding == "redoOrder"


def test_consolidated_moves(spark):
    """Two reviewers move one block to different places."""
    texts = ["first block of text", "second block stays", "third block also stays", "fourth one ends it"]
    rows = lambda t: [(1, o, x) for o, x in enumerate(t)]
    base = spark.createDataFrame(rows(texts), "doc_id long, ord long, text string").withColumn("hash", F.sha2("text", 256))
    a, b, c, d = texts
    v = spark.createDataFrame([(1, 1, o, x) for o, x in enumerate([b, a, c, d])] + [(1, 2, o, x) for o, x in enumerate([b, c, d, a])], "doc_id long, reviewer int, ord long, text string").withColumn("hash", F.sha2("text", 256))
    got = {p: [x["text"] for x in compose.consolidated(base, v, p).orderBy("ord").collect()] for p in compose.POLICIES}
    assert got["baseWins"] == texts and sorted(got["firstReviewerWins"]) == sorted(texts) and len(got["stackAll"]) == 5
