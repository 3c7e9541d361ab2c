"""Sequence kernels against plain versions, office files by round trips, streams against their batch twins."""

import io
import random
import zipfile
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.operators import align, cascade, session
from quirelake.sources import office


def lis_length(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    return max(best, default=0)


@given(st.lists(st.integers(0, 20), max_size=30))
def test_lis(values):
    flags = align.lis_flags(values)
    chain = [v for v, f in zip(values, flags) if f]
    assert chain == sorted(set(chain)) and len(chain) == lis_length(values)


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 5)), max_size=10))
def test_weighted_lis(pairs):
    values, weights = [p[0] for p in pairs], [p[1] for p in pairs]
    flags = align.weighted_lis_flags(values, weights)
    best = max((sum(weights[i] for i in c) for n in range(len(pairs) + 1) for c in combinations(range(len(pairs)), n) if all(values[a] < values[b] for a, b in zip(c, c[1:]))), default=0)
    chain = [i for i, f in enumerate(flags) if f]
    assert all(values[a] < values[b] for a, b in zip(chain, chain[1:])) and sum(weights[i] for i in chain) == best


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
@settings(max_examples=300)
def test_myers(a, b):
    pairs = align.myers(list(a), list(b))
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
    assert len(pairs) == lcs(a, b)


@given(st.lists(st.sampled_from(["a", "b", "The", " ", ",", "x"]), max_size=12), st.lists(st.sampled_from(["a", "b", "the", " ", ",", "x"]), max_size=12))
def test_diff_spans(a, b):
    spans = align.diff_spans(a, b)
    assert "".join(s[1] for s in spans) == "".join(a) and "".join(s[2] for s in spans) == "".join(b)


def test_replay():
    rows = session.replay([(1, "do"), (2, "do"), (3, "undo"), (4, "redo"), (5, "undo"), (6, "do"), (7, "redo"), (8, "undo"), (9, "undo"), (10, "undo")])
    assert [r[1:] for r in rows] == [(1, 0, 1, True), (2, 0, 2, True), (1, 1, 1, True), (2, 0, 2, True), (1, 1, 1, True), (2, 0, 6, True), (2, 0, 6, False), (1, 1, 1, True), (0, 2, None, True), (0, 2, None, False)]
    assert session.replay([(i, "do") for i in range(60)])[-1][1] == session.DEPTH


def test_list_counters():
    one = [1, 1, 1]
    items = [(0, 1, one, None, False), (1, 1, one, None, False), (1, 1, one, None, False), (0, 1, one, None, True), (0, 1, one, None, False), (2, 1, one, None, False), (0, 2, one, 10, False), (0, 2, one, 10, False)]
    assert cascade.count_items(items) == [[1], [1, 1], [1, 2], [2], [2], [2, 1, 1], [10], [11]]


def test_css():
    rules = cascade.parse_css("/* x */ p, .a { margin: 1px 2px 3px; color: RED !important } #i.b{padding:0}")
    assert ("p", 1, "margin-left", "2px", False) in {(s, sp, p, v, i) for s, sp, _, p, v, i in rules}
    assert any(s == "#i.b" and sp == 110 for s, sp, *_ in rules)
    assert any(p == "color" and i for _, _, _, p, _, i in rules)


DOCUMENT = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(**{"word/document.xml": DOCUMENT}))
    (tmp_path / "bad.docx").write_bytes(b"not a package")
    found = office.files(spark, str(tmp_path), "*.docx")
    rows = office.docx_blocks(found).orderBy("path", "ord").collect()
    assert [(r["kind"], r["text"], r["row"]) for r in rows if not r["error"]] == [("h", "Title", None), ("p", "a\tnew", None), ("p", "c", 0)]
    assert [r["error"] is not None for r in rows].count(True) == 1
    assert [r["text"] for r in office.docx_blocks(found, "reject").where("ord = 1").collect()] == ["a\told"]
    assert office.package_entries(found).where("uri = 'word/document.xml'").count() == 1


def test_workbook_round_trip(spark, tmp_path):
    data = spark.createDataFrame([(1, 1, "x & <y>", 1.5), (1, 2, None, 2.0), (2, 1, "z", -1.0)], "k long, n long, t string, v double")
    for r in office.workbooks(data, "k", ["n"], ["n", "t", "v"]).collect():
        (tmp_path / f"{r['k']}.xlsx").write_bytes(bytes(r["content"]))
    cells = office.xlsx_cells(office.files(spark, str(tmp_path), "1.xlsx")).collect()
    got = {c["ref"]: (c["kind"], c["value"]) for c in cells}
    assert got["A1"] == ("string", "n") and got["B2"] == ("string", "x & <y>") and got["C3"] == ("number", "2.0") and "B3" not in got


def test_markdown_mht_image(spark):
    assert [r[1:] for r in office.markdown_rows("# T\n\na\nb\n- x\n1. y")] == [("h", 1, "T"), ("p", 0, "a b"), ("li", 0, "x"), ("ol", 0, "y")]
    with pytest.raises(ValueError):
        office.markdown_rows("```")
    mht = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=b\r\n\r\n--b\r\nContent-Type: text/html\r\nContent-Location: http://x/\r\n\r\n<p>hi</p>\r\n--b--\r\n"
    assert office.mht_rows(mht)[0][1:3] == ("http://x/", "text/html")
    assert office.image_rows(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (5).to_bytes(4, "big") + (7).to_bytes(4, "big")) == [("png", 5, 7)]


def test_stream_equals_batch(spark, sf):
    from quirelake.plans import registry

    q = registry.queries()
    key = lambda df: sorted(map(tuple, df.select("session", "event", "undo_depth", "redo_depth", "top", "done").collect()))
    assert key(q["session_stream_state"](spark, sf)) == key(q["undo_redo_replay"](spark, sf))


def test_greedy_matches_plain(spark):
    from pyspark.sql import functions as F

    random.seed(1)
    rows = list({(1, random.randrange(6), random.randrange(6)): round(random.random(), 1) for _ in range(40)}.items())
    scores = spark.createDataFrame([(*k, v) for k, v in rows], "doc_id long, left_ord long, right_ord long, score double")
    got = {(r["left_ord"], r["right_ord"]) for r in align.greedy_best_first(scores, 0.3).collect()}
    left, right, want = set(), set(), set()
    for (_, a, b), s in sorted(rows, key=lambda x: (-x[1], x[0][1], x[0][2])):
        if s >= 0.3 and a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    assert got == want and F is not None


def test_split_run():
    from collections import Counter

    from quirelake.operators.layout import split_run

    parts = [Counter("x y z".split()), Counter("a b c".split()), Counter("d e f".split()), Counter("q".split())]
    assert split_run("a b c d e f".split(), parts, [1, 2]) == (1, 2)
    assert split_run("a b c d e f g h".split(), parts, [1, 2]) is None
    assert split_run([], parts, [0]) is None


def test_expect_takes_the_next_rule_left(spark):
    """Rows of one kind use up rules from the most specific to the wildcard; random rules against a plain loop."""
    import random

    from quirelake.operators import delta

    rules = [(1, None, None), (2, "F", None), (4, "F", "U")]
    rows = [(1, "F", "U"), (2, "F", "U"), (3, "F", "U"), (4, "F", "U")]
    rnd = random.Random(4)
    pick = lambda: rnd.choice("ABC")
    cases = [(rows, rules)] + [([(i, pick(), pick()) for i in range(40)], [(r, rnd.choice([None, pick()]), rnd.choice([None, pick()])) for r in range(8)]) for _ in range(2)]
    for rows, rules in cases:
        left, want = list(rules), {}
        for i, a, b in rows:
            fits = sorted((r for r in left if r[1] in (None, a) and r[2] in (None, b)), key=lambda r: ((r[1] is None) + (r[2] is None), r[0]))
            want[i] = fits[0][0] if fits else None
            left = [r for r in left if not fits or r != fits[0]]
        got = delta.expect(spark.createDataFrame(rows, "id long, x string, y string"), spark.createDataFrame(rules, "rule long, x string, y string"), ["x", "y"])
        assert {r["id"]: r["rule"] for r in got.collect()} == want
