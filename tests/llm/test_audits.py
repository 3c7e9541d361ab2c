"""Conversation repair, filter audit and URL filters against brute-force versions, and on odd tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from quirelake.llm import audit, registry, repair, urls

SPACE = " \t\n\v\f\r"


# Conversation repair ----------------------------------------------------------------------------------------------------


def harmed(rows):
    """Rows after damage, grouped by conv_id and in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        row = (turn, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)
        out[conv] += [row] * {0: 0, 3: 2}.get(harm, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) and its lines over all edits, by trying them all from each row and role initial on."""
    fault, memo = faults(rows), {}

    def go(i, last, inserts=0):
        if (i, last, inserts) in memo:
            return memo[i, last, inserts]
        due = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserts < 3:
            cost, letters, lines = go(i, due, inserts + 1)
            options.append((cost + 2, "I" + letters, (f"{name}:", *lines)))
        if i < len(rows):
            cost, letters, lines = go(i + 1, last)
            options.append((cost + 3, "D" + letters, lines))
            _, role, text = rows[i]
            if fault[i] not in ("blank", "duplicate"):
                more = fault[i] == "truncated"
                if role[:1] == due or role[:1] == "s" and last == "":
                    cost, letters, lines = go(i + 1, role[:1])
                    options.append((cost + more, "K" + letters, (f"{role}:{text}", *lines)))
                cost, letters, lines = go(i + 1, due)
                options.append((cost + 2 + more, "R" + letters, (f"{name}:{text}", *lines)))
        memo[i, last, inserts] = min(options, default=(10**9, "", ()))
        return memo[i, last, inserts]

    return go(0, "") if rows else (0, "", ())


def expected(rows):
    out = set()
    for conv, own in harmed(rows).items():
        f = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, letters, lines = cheapest(own)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def invented(seed, conversations, turns):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", None, "so be it!", "é 漢字 😀.", "end \n"]
    return [(c if c else None, r.choice([t, t, t, None, t // 2]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage"]), r.choice(texts + [f"text {i}." for i in range(9)])) for c in range(conversations) for t in range(r.choice(turns))]


@pytest.mark.parametrize(("long_turns", "long_chars"), [(1024, 4_000_000), (3, 4_000_000), (5, 20)])
def test_op11_brute(spark, long_turns, long_chars):
    """The same results whether conversations go whole or in segments."""
    rows = invented(1, 60, (1, 2, 5, 9, 14)) + [(777, t, "user", "a.") for t in range(20)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string")
    got = repair.repair(table, long_turns, long_chars).collect()
    assert len(got) == len({r[0] for r in rows}) and {tuple(r) for r in got} == expected(rows)


def test_op11_columns_of_turns():
    """One conversation in columns of any number of turns has the edits that it has in one."""
    r = random.Random(3)
    for _ in range(40):
        code = repair.np.array([r.choice([0, 1, 2, 2, 3, 3]) + 4 * r.choice([0, 0, 0, 1, 2, 3]) for _ in range(r.randint(1, 60))], dtype="int8")
        ((cost, letters),) = repair.repaired([code])
        for turns in (1, 2, 7, 100):
            assert repair.repaired_long(code, turns)[:2] == (cost, b"".join(letters))


def test_op11_odd(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(table).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "word " * 400_000), (1, 2, "assistant", "yes."), (2, None, None, None)], table.schema)
    assert {tuple(r) for r in repair.repair(long, 1024, 1000).collect()} == {tuple(r) for r in repair.repair(long).collect()}


# Filter audit -----------------------------------------------------------------------------------------------------------


def audited(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))  # a null id has no labels
    out = []
    parts = collections.defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        parts[lang or ""].append((i, {f for f, x in fails.items() if x}))
    for part, own in parts.items():
        removals = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removals[f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)])
        for row in out[-600:]:
            row.append(removals[row[1][row[2] - 1]])
    return sorted(map(tuple, out))


def test_op12_brute(spark, docs, odd):
    r = random.Random(5)
    texts = [" ".join(r.choices(["word", "Other", "THIRD", "a#b"] + [f"w{i}" for i in range(r.choice([5, 300]))], k=r.choice([3, 99, 100, 160]))) for _ in range(40)]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), "s") for i in range(150)] + [(r[0], r[1], *(r[2:] or ("en", "s"))) for r in odd]
    labels = [(i, i % 2, i % 3) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.effects(audit.joint_failures(audit.judged(docs(rows), table)))
    assert sorted(map(tuple, got.collect())) == audited([r[:3] for r in rows], labels)
    assert audit.effects(audit.joint_failures(audit.judged(docs([]), table))).count() == 0


# URL filters ------------------------------------------------------------------------------------------------------------


def test_op13_parts_and_rules(spark):
    cases = {
        "https://A.Example.COM/en/1?x=/fr/#top": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://m.www.example.com/en/1": ("m.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
        "http://example.com?x": ("example.com", "", None, None), "x://y://z/es/": ("y:", "//z/es/", None, None), "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"),
        "no scheme": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "://NET/fr/\n9": ("net", "/fr/\n9", "net/fr/", "block"),
    }
    table = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = urls.parts(table["url"])
    rule = urls.ruled(host, path)
    got = {r[0]: tuple(r)[1:] for r in table.select("url", host, path, rule["rule"], rule["verdict"]).collect()}
    assert got == cases


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, verdict string")


def test_op13_verdicts(spark):
    """URLs like the blocked ones are blocked and others allowed, whatever part of the n-grams is broadcast."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    rows = [(i, f"http://{word()}.com/news/{word()}") for i in range(300)] + [(i, f"http://{word()}.net/es/casino-win-{i}") for i in range(300, 600)]
    open_ = [(i, f"http://{word()}.org/news/{word()}") for i in range(600, 640)] + [(i, f"http://{word()}.org/es/casino-win-{i}") for i in range(640, 680)]
    odd = [(None, None), (None, None), (700, ""), (701, "no scheme"), (700, ""), (702, "http://x.org/" + "long" * 50_000), (703, "é漢😀://ü.org/ß")]
    table = pages_of(spark, rows + open_ + odd)
    found = [sorted(map(str, urls.url_filters(table, head=head).collect())) for head in (1, 1000, 10**9)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows + open_ + odd)
    verdict = {r["page_id"]: r["verdict"] for r in urls.url_filters(table).collect()}
    assert sum(verdict[i] == "allow" for i in range(600, 640)) >= 36 and sum(verdict[i] == "block" for i in range(640, 680)) >= 36
    assert urls.url_filters(pages_of(spark, [])).count() == 0
    assert {r["verdict"] for r in urls.url_filters(pages_of(spark, odd)).collect()} <= {"allow", "block"}


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_filter_audit", "op13_url_filters"])
def test_sql_on_odd_rows(spark, name, tmp_path, odd):
    """The SQL gives the same rows on tables with nulls, repeated rows and repeated ids."""
    t = {
        "conversations": spark.createDataFrame(invented(2, 25, (1, 2, 5, 9)), "conv_id long, turn long, role string, text string"),
        "documents": spark.createDataFrame([(x[0], x[1], x[2] if len(x) > 2 else "en") for x in odd], "doc_id long, text string, lang string"),
        "labels": spark.createDataFrame([(4, 1, 0), (5, None, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"),
        "pages": pages_of(spark, [(1, "http://a.com/x"), (1, "http://a.com/x"), (2, "http://b.net/es/1"), (None, "http://c.org/é?"), (3, None), (4, "x"), *[(i, f"http://h{i}.{('com', 'net', 'org')[i % 3]}/{('fr', 'es')[i % 2]}/{i}") for i in range(5, 90)]]).select("page_id", "url"),
    }
    c = duckdb.connect()
    for n, df in t.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{n}.parquet")
        c.sql(f"create view {n} as select * from '{tmp_path}/{n}.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, str(tmp_path)), c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
