"""Each operator against a brute-force version, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelake.llm import common, components, decontaminate, html, lines, lm, packing, partenum, quality, registry, sharding, suffixes, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(columns, found):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in by)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = c.execute(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


# Odd tables -------------------------------------------------------------------------------------------------------------


def test_op2_odd(spark, docs, odd):
    out = lines.line_dedup(docs(odd)).collect()
    assert len(out) == len(odd) and sum(r["n_removed"] for r in out) == 0
    assert lines.line_dedup(docs([])).count() == 0
    many = docs([(i, f"Menu\n own text {i}\nMenu\n", "en", f"s{i}") for i in range(1, 21)] + [(30, None), (31, "Menu", "en", None)])
    got = {r["doc_id"]: r for r in lines.line_dedup(many).collect()}
    assert got[1]["text"] == "Menu\n own text 1\n" and got[2]["text"] == " own text 2\n" and got[30]["text"] is None and got[31]["text"] == ""


def test_op2_near_threshold(spark, docs):
    """Lines on exactly one site less than the threshold stay, whatever the sketch says."""
    table = docs([(i, f"fourteen\nfifteen\n{i}" if i % 20 < 14 else f"fifteen\n{i}" if i % 20 == 14 else f"{i}", "en", f"s{i % 20}") for i in range(200)])
    left = " ".join(r["text"] for r in lines.line_dedup(table).collect())
    assert left.count("fourteen") == 140 and left.count("fifteen") == 1


def test_op3_odd(spark, docs, odd):
    out = {(r["doc_id"], r["n_tokens"]) for r in lm.score(docs(odd)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 60_001)} <= out
    assert lm.score(docs([])).count() == 0
    only = lm.score(docs([(18, "a b")])).collect()[0]  # whatever its remainder, a single text is scored
    assert math.isfinite(only["score"]) and math.isfinite(only["base_score"])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_op3_brute(spark, docs, order):
    own = documents(spark)[:60]
    tokens = {i: ["\0B"] * (order - 1) + WORD.findall(ascii_lower(t)) + ["\0E"] for i, t in own}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(tuple(t[k : k + n]) for t in train for n in range(1, order + 1) for k in range(len(t) - n + 1))
    words = {g[0]: c for g, c in count.items() if len(g) == 1 and g[0] != "\0B"}
    total, types = sum(words.values()), len(words)

    def p(gram):
        c = count[gram]
        if len(gram) == 1:
            return (c - lm.DISCOUNT) / total if c else lm.DISCOUNT * types / total
        seen, low = count[gram[:-1]], p(gram[1:])
        return (c + lm.STRENGTH * low) / (seen + lm.STRENGTH) if seen else low

    for r in lm.score(docs(own), order=order, chunk_bytes=20_000, shard_bytes=5_000).collect():
        t = tokens[r["doc_id"]]
        mine = t[order - 1 :]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(mine), sum(w in words for w in mine), total, zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((words.get(w, 0) + 0.1) / (total + 0.1 * (types + 1))) for w in mine))
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(t[k - order + 1 : k + 1]))) for k in range(order - 1, len(t))))


def test_op3_automaton():
    """States, arcs and failure arcs of a small model; the state is carried from word to word."""
    import numpy as np

    seq, starts = lm.sequences([b"a b a c", b"b d"], 3)
    levels = [lm.Level(seq, starts, n) for n in (1, 2, 3)]
    for n, level in enumerate(levels, 1):  # as if the first text alone were training
        mine = lm.gram_keys(seq, n)[lm.places(starts[:2], n)]
        level.counts = np.array([np.count_nonzero(mine == k) for k in level.keys])
    model = lm.BackoffAutomaton(levels, 5, 4)
    seen = sum(int((x.counts > 0).sum()) for x in levels[:2])
    assert len(model.fail) == 1 + seen and len(model.arcs) == sum(int((x.counts > 0).sum()) for x in levels)
    depth = lambda s: 0 if s == 0 else 1 + depth(model.fail[s])
    assert depth(model.start) == 2 and max(map(depth, range(1 + seen))) == 2 and {depth(t) for t in model.target} == {1, 2}
    word = levels[0].starting[lm.places(starts, 3) + 2].astype(np.int64)  # both texts with their ends
    cuts = np.array([0, 5, 8])
    whole = model.traverse(word, cuts)
    state, total = np.array([model.start]), 0.0
    for w in word[5:]:
        state, weight = model.step(state, np.array([w]))
        total += weight[0]
    assert whole[1] == pytest.approx(total)
    for stride in (1, 2, 3):
        assert model.traverse(word, cuts, stride) == pytest.approx(whole)


def check_sequences(out, texts, capacities):
    """Each word of each text is in the sequences once, in order; sequences are as small as they can be."""
    found = collections.defaultdict(list)
    for r in out:
        words, ends = r["text"].split(" "), 0
        for i, piece, start, offset, n in zip(r["doc_ids"], r["pieces"], r["starts"], r["offsets"], r["lengths"]):
            assert offset == ends and n <= max(capacities)
            ends += n
            found[i].append((piece, start, words[offset:ends]))
        assert ends == len(words) == r["used"] and r["padding"] == r["capacity"] - ends >= 0 and not any(ends <= c < r["capacity"] for c in capacities)
    got = collections.Counter()
    for i, own in found.items():
        assert all(start == piece * max(capacities) for piece, start, _ in own)
        got.update((i, tuple(w)) for _, _, w in own)
    most = max(capacities)
    want = collections.Counter((i, tuple(w[k : k + most])) for i, w in ((i, WORD.findall(t or "")) for i, t in texts) for k in range(0, len(w), most))
    assert got == want


def test_op4(spark, docs, odd):
    out = packing.pack(docs(odd)).collect()
    check_sequences(out, [(r[0], r[1]) for r in odd], packing.CAPACITIES)
    assert packing.pack(docs([])).count() == 0
    texts = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate(random.Random(4).choices(range(1, 6000), k=300))]
    texts += [(None, "no id"), (None, "no id"), (None, "nor this"), (2**53 + 1, "big"), (2**53 + 1, "big")]
    for group in (packing.GROUP_BYTES, 400_000):
        out = packing.pack(docs(texts), group_bytes=group).collect()
        check_sequences(out, texts, packing.CAPACITIES)
        assert len({r["bin_id"] for r in out}) == len(out) and sum(r["used"] for r in out) > 0.85 * sum(r["capacity"] for r in out)
    named = docs(texts).selectExpr("string(doc_id) || 'x' doc_id", "text")
    assert {i for r in packing.pack(named).collect() for i in r["doc_ids"]} == {None if i is None else f"{i}x" for i, _ in texts}


def test_op4_best_fit():
    """Against a search through all bins: the tightest open bin that holds a piece gets it, else one of least cost."""
    import numpy as np

    rnd, caps = random.Random(6), (16, 32, 64)
    for _ in range(20):
        lengths = sorted(rnd.choices(range(1, 65), k=200), reverse=True)
        bins, offsets, final = packing.best_fit(np.array(lengths), caps, 4)
        room, used = {}, collections.Counter()
        left = np.bincount(lengths, weights=lengths, minlength=65)
        small = None
        for n, b, at in zip(lengths, bins.tolist(), offsets.tolist()):
            left[n] -= n
            fits = [r for r in room.values() if r >= n]
            if fits:
                assert room[b] == min(fits)
            else:
                small = np.cumsum(left) / max(1.0, left.sum()) if small is None else small
                cost = {c: (c + 4 - (c - n) * small[min(c - n, 64)]) / n for c in caps if c >= n}
                room[b] = min(cost, key=cost.get)
            assert at == used[b]
            room[b] -= n
            used[b] += n
        assert final.tolist() == [next(c for c in caps if c >= used[b]) for b in range(len(final))]


def test_op5_odd(spark, docs, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (3, "word"), (4, "over the hill towards the river to drink some cold water")], "item_id long, text string")
    out = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_list"])) for r in decontaminate.report(docs([*odd, (20, "A dog ran over the hill towards the river to drink some cold water")]), bench).collect()}
    assert {(1, 0, 0, ()), (4, 1, 1, ("3",)), (5, 1, 1, ("3",)), (20, 14, 11, ("4",)), (6, 60_000, 0, ())} <= out
    assert decontaminate.report(docs([]), bench).count() == 0
    assert decontaminate.report(docs(odd), bench.where("false")).where("contaminated").count() == 0
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs(odd), bench).collect()} == {1, 2, 3, 6, 7, 8, 9, None}
    hidden = docs([(None, "so a dog ran over the hill towards the river to drink some cold water"), (None, "clean"), (None, None)])
    assert [r["text"] for r in decontaminate.decontaminate(hidden, bench).collect()] in (["clean", None], [None, "clean"])


def test_op5_repeated_items(spark, docs):
    """A repeated item, and an id with two texts, are found by any one window of theirs."""
    item, other = [f"w{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (1, " ".join(other)), (2, "absent " + " ".join(other))], "item_id long, text string")
    rows = [(s, f"before {' '.join(w[s % 20 : s % 20 + 10])} after") for s, w in [(i, item) for i in range(11)] + [(20 + i, other) for i in range(11)]]
    rows += [(50, " ".join(item[:9])), (51, " ".join(item[:5] + other[5:10])), (52, " ".join(item + other))]
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs(rows), bench).collect()}
    assert got == {**{i: 10 for i in (*range(11), *range(20, 31))}, 50: 0, 51: 0, 52: 40}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs(rows), bench).collect()} == {50, 51}


def test_op5_proximity(spark, docs):
    table = docs([(1, "alpha one two beta"), (2, "alpha one two three four beta"), (3, "beta alpha")])
    terms = spark.createDataFrame([("alpha",), ("beta",)], "term string")
    near = decontaminate.proximity_matches(decontaminate.postings(table, terms), ["alpha", "beta"], 3)
    assert {(bytes(r["text_key"]), r["pos"]) for r in near.collect()} == {(hashlib.md5(t).digest(), k) for t, k in ((b"alpha one two beta", 0), (b"beta alpha", 1))}


def test_op6_odd(spark, tmp_path):
    big = "<p>" + "x" * 1500 + "</p>"
    pages = spark.createDataFrame([(1, "http://a/", big, "z"), (2, None, big, "z"), (3, "http://b/\r\nx", None, "z"), (4, "http://c/", "", "z"), (5, "http://d/", "WARC/1.1\r\n\r\n\r\n\r\né", "z"), (6, "http://d/", "small", "z"), (7, "http://e/", "small", "z")], "page_id long, url string, html string, digest string")
    warc.write_warc(pages, str(tmp_path / "w"), file_captures=2)
    got = {r["page"]: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))).withColumn("page", warc.page_of(F.col("record_id"))).withColumn("last", warc.page_of(F.col("refers_to"))).collect()}
    one = lambda i: got[str(i)]
    assert len(got) == 7 and one(1)["record_type"] == "revisit" and one(1)["last"] == "2"
    assert bytes(one(1)["payload"]).decode() == big and bytes(one(5)["payload"]).decode() == "WARC/1.1\r\n\r\n\r\n\r\né" and one(3)["payload_bytes"] == 0
    assert one(6)["record_type"] == one(7)["record_type"] == "response" and warc.capture_id and one(4)["request"]["target_uri"] == "http://c/" and one(4)["metadata"] is not None
    assert one(1)["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    warc.write_warc(pages.where("false"), str(tmp_path / "none"))
    assert warc.sha1_hex("sha1:" + __import__("base64").b32encode(bytes(20)).decode()) == "0" * 40


def test_op6_rows(spark, tmp_path):
    """One capture for each row: ids that repeat with equal or other html, null ids, ids beyond 2**53, a long payload."""
    big, long = "y" * 1200, "é" * 3_000_000
    rows = [(1, "u", big), (1, "u", big), (1, "v", big), (1, "u", "other"), (None, "u", big), (None, "u", "x"), (None, None, None), (None, None, None), (2**53 + 1, "u", "x"), (2**53 + 3, "u", "x"), (5, "u", long)]
    rows += [(7, "w", "same")] * 2500
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    out = warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))).select(warc.page_of(F.col("record_id")).cast("long").alias("page_id"), "url", "payload", "record_type", "request", "metadata", "record_id").collect()
    assert len({r["record_id"] for r in out}) == len(rows) and all(r["request"] and r["metadata"] for r in out)
    assert sorted(repr((r["page_id"], r["url"], bytes(r["payload"]).decode())) for r in out) == sorted(repr((i, u, h or "")) for i, u, h in rows)
    assert sum(r["record_type"] == "revisit" for r in out) == 3


def test_op7_stats():
    def brute(text):
        text = text or ""
        words = WORD.findall(text)
        windows = collections.defaultdict(list)
        for k in range(len(words) - 4):
            windows[tuple(words[k : k + 5])].append(k)
        rep = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)

    rnd = random.Random(7)
    texts = [None, "", " \n", "a b c d e " * 3, "x\nx\n x\n\x0b\n", "É ß #   漢 😀"] + ["".join(rnd.choice("ab #|\né ") for _ in range(rnd.randrange(200))) for _ in range(200)]
    for t in texts:
        assert quality.text_stats(t) == brute(t)


def test_op7_odd(spark, docs, odd):
    out = {(r["doc_id"], r["n_words"]): r for r in quality.quality_rules(docs(odd)).collect()}
    assert out[1, 0]["base_failed"] and not out[1, 0]["kept"] and out[1, 0]["log_perplexity"] is None and out[6, 60_000]["n_repeat_words"] == 60_000
    assert quality.quality_rules(docs([])).count() == 0


def test_op7_model():
    """Probabilities after any context add up to one; hash arrays find what a dictionary finds."""
    import numpy as np

    g, ends = quality.grams(["abracadabra", "banana bandana", ""], 3)
    assert ends.tolist() == [11, 25, 25] and len(g) == 25
    keys, n = np.unique(g, return_counts=True)
    model = quality.KneserNey(keys, n)
    letters = np.array(sorted({ord(x) for x in "abracadabra banana bandana"}))
    for context in ("ab", "an", "zz", "  ", "漢字"):
        c = ord(context[0]) << quality.CHAR_BITS | ord(context[1])
        every = (10 ** model.logp(c << quality.CHAR_BITS | letters)).sum() + 10 ** model.logp(np.array([c << quality.CHAR_BITS | 0x4E00]))[0]
        assert every == pytest.approx(1, abs=1e-4)


def brute_perplexities(texts, order=3):
    """log10 probabilities of all characters by modified Kneser-Ney, from dictionaries."""
    pad = " " * (order - 1)
    top = collections.Counter((pad + t)[k : k + order] for t in texts for k in range(len(t)))
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    off = {}
    for n, level in levels.items():
        few = [sum(c == k for c in level.values()) for k in (1, 2, 3, 4)]
        y = few[0] / (few[0] + 2 * few[1]) if few[0] and few[1] else 0.5
        off[n] = [0.0] + [min(max(k - (k + 1) * y * few[k] / few[k - 1], 0.05), k - 0.05) if few[k - 1] and few[k] else 0.5 for k in (1, 2, 3)]
    totals, lost = {}, {}
    for n, level in levels.items():
        for g, c in level.items():
            totals[n, g[:-1]] = totals.get((n, g[:-1]), 0) + c
            lost[n, g[:-1]] = lost.get((n, g[:-1]), 0) + off[n][min(c, 3)]

    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else 1 / (len(levels[1]) + 1)
        if (n, g[:-1]) not in totals:
            return low
        total, c = totals[n, g[:-1]], levels[n].get(g, 0)
        return (c - off[n][min(c, 3)]) / total + lost[n, g[:-1]] / total * low

    return [[math.log10(p((pad + t)[k : k + order])) for k in range(len(t))] for t in texts]


def test_op7_brute(spark, docs):
    """Perplexities, bands and verdicts against dictionaries and plain quantiles."""
    import numpy as np

    rnd = random.Random(17)
    rows = []
    for lang, letters in (("aa", "abcdefgh  "), ("zh", "漢字仮名交文章語 "), (None, "éèàçü xyz ")):
        word = lambda n: "".join(rnd.choice(letters) for _ in range(n))  # noqa: E731, B023
        rows += [(len(rows) + i, word(rnd.choice([90, 300, 1200, 2500])), lang, "s") for i in range(40)]
        rows += [(len(rows) + i, "".join(chr(rnd.randrange(33, 126)) + " " * (i % 3 == 0) for i in range(400)), lang, "s") for i in range(2)]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs(rows)).collect()}
    for lang in ("aa", "zh", None):
        own = [r for r in rows if r[2] == lang]
        value = {}
        for r, logs in zip(own, brute_perplexities([t for _, t, *_ in own])):
            cuts = np.linspace(0, len(logs), max(1, len(logs) // quality.BLOCK) + 1).astype(int)
            value[r[0]] = np.median([-sum(logs[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:])])
            assert got[r[0]]["log_perplexity"] == pytest.approx(value[r[0]], abs=1e-4)
        sound = [r for r in own if not got[r[0]]["base_failed"]]
        bins = lambda x, w: (math.floor(x / w) + 0.5) * w
        at = lambda v, q, w: bins(sorted(v)[max(0, math.ceil(q * len(v)) - 1)], w)
        mine = {r[0]: got[r[0]]["log_perplexity"] for r in own}
        long = [mine[r[0]] for r in sound if len(r[1]) >= 1000]
        every = [mine[r[0]] for r in sound]
        short = [abs(mine[r[0]] - at(every, 0.5, quality.BIN)) * math.sqrt(len(r[1])) for r in sound if len(r[1]) < 1000]
        spread = max((at(long, 0.75, quality.BIN) - at(long, 0.25, quality.BIN)) / 1.349, 2 * quality.BIN)
        noise = max(at(short, 0.5, 25 * quality.BIN) / 0.6745, 0.5)
        for r in own:
            width = quality.BAND_SIGMAS * math.sqrt(spread**2 + noise**2 / max(1, len(r[1])))
            inside = abs(mine[r[0]] - at(long, 0.5, quality.BIN)) <= width
            assert got[r[0]]["kept"] == (inside and not got[r[0]]["base_failed"])
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in got.values())


def test_op7_models_that_do_not_fit(spark, docs):
    """A model larger than its bound loses its rarest n-grams, not texts."""
    table = docs([(i, f"some words of text number {i} in a language of its own here", "l", "s") for i in range(30)])
    got = quality.scored(table, model_bytes=40 * quality.ENTRY_BYTES).collect()
    assert len(got) == 30 and all(r["log_perplexity"] > 0 for r in got)


def test_op7_large_models_lose_nothing(spark, docs):
    """A language whose model doesn't fit has the perplexities of the whole model."""
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("abcdefghij  ") for _ in range(rnd.choice([3, 90, 450]))), ("big", None, "small")[i % 3] if i < 40 else "big", "s") for i in range(60)]
    rows = [(i, t[:20] if lang == "small" else t, lang, s) for i, t, lang, s in rows] + [rows[0], (None, rows[0][1], "big", "s"), (99, None, "big", "s"), (98, "", None, "s")]
    read = lambda size: sorted(((r["doc_id"] or -1, str(r["lang"]), r["log_perplexity"], r["n_words"]) for r in quality.scored(docs(rows), model_bytes=size).collect()), key=lambda x: (x[0], x[1], x[2] or 0))
    whole, cut = read(quality.MODEL_BYTES), read(300 * quality.ENTRY_BYTES)
    assert len(whole) == len(rows) and [x[:2] + x[3:] for x in whole] == [x[:2] + x[3:] for x in cut]
    assert [x[2] for x in cut] == [x[2] if x[2] is None else pytest.approx(x[2], abs=1e-6) for x in whole]


def test_op7_rejects_noise_keeps_clean(spark, docs):
    rnd = random.Random(5)
    syl = ["ba", "ke", "lo", "mi", "tu", "ran", "sel", "der"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4)))
    clean = [(i, " ".join(word() for _ in range(120))) for i in range(150)]
    noise = [(1000 + i, " ".join("".join(chr(rnd.randrange(33, 126)) for _ in range(6)) for _ in range(120))) for i in range(8)]
    kept = {r["doc_id"] for r in quality.quality_rules(docs(clean + noise)).where("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_op7_passes(spark, docs):
    """Models that don't fit one pass are taken in several, with the same results."""
    table = docs([(i, f"some words of text number {i} in a language of its own here", f"l{i % 3}", "s") for i in range(30)])
    key = lambda df: sorted((r["doc_id"], round(r["log_perplexity"], 9)) for r in df.collect())
    assert key(quality.scored(table)) == key(quality.scored(table, model_bytes=150 * quality.ENTRY_BYTES))


def test_op8(spark, docs, odd, tmp_path):
    table = docs(odd)
    store = sharding.size_tiered(table, str(tmp_path / "s"), arrivals=5, base_bytes=1 << 20)
    assert store.read().exceptAll(table).count() == table.exceptAll(store.read()).count() == 0
    assert len(store.manifest()["runs"]) == 2 and store.versions() == [store.manifest()["version"]]
    base = store.manifest()
    store.append(table)
    with pytest.raises(sharding.CommitConflict):
        store.commit(base, [])
    assert store.read().count() == 2 * len(odd) and store.read(base["version"]).count() == len(odd)
    assert sharding.size_tiered(docs([]), str(tmp_path / "e")).read().count() == 0


def test_op8_tiers(spark, tmp_path):
    """Runs move up tier by tier; finished files are left alone; rows of clashing names and long texts come back."""
    table = spark.range(4000).selectExpr("id", "repeat(sha2(string(id), 512), 20) text", "id % 3 __arrival0")
    store = sharding.ShardStore(spark, str(tmp_path / "t"), base_bytes=20_000, target_bytes=600_000)
    store.append_arrivals(table, 16)
    assert len(store.manifest()["runs"]) == 16 and len(store.versions()) == 16
    tiers = {store.tier(r) for r in store.manifest()["runs"]}
    store.compact()
    runs = store.manifest()["runs"]
    assert len(runs) < 4 and max(store.tier(r) for r in runs) > max(tiers) or any(store.tier(r) == -1 for r in runs)
    assert store.read().exceptAll(table).count() == 0 and store.read().count() == 4000
    assert store.vacuum(keep=2, grace_s=0) > 0 and len(store.versions()) == 2 and all(store.read(v).count() == 4000 for v in store.versions())
    with pytest.raises(ValueError):
        store.read(1)


def test_op8_racing_writers(spark, docs, tmp_path):
    """Of writers that try one version at once a single one succeeds, and appends beside a merge lose nothing."""
    table = docs([(1, "a"), (2, "b")]).coalesce(1)
    store = sharding.ShardStore(spark, str(tmp_path / "r"), fanout=3)
    base = store.append(table)

    def attempt(i):
        try:
            return store.commit(base, base["runs"])["version"]
        except sharding.CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(attempt, range(16)))
        assert [v for v in won if v is not None] == [2]
        jobs = [pool.submit(store.append, table) for _ in range(6)] + [pool.submit(store.compact) for _ in range(2)]
        [j.result() for j in jobs]
    store.compact()
    assert store.read().count() == 14 and store.versions() == list(range(1, len(store.versions()) + 1))
    store.vacuum(grace_s=0)
    assert store.read().count() == 14


def brute_dedup(texts):
    first = {}
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0])):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            f = first[t[k : k + 50]]
            if f is not None and (i is None or f < i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op9_brute(spark, docs, odd):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(40, 400))) for _ in range(12)]
    texts = [(i, "".join(rnd.choice(base)[rnd.randrange(30) :][: rnd.randrange(20, 300)] for _ in range(rnd.randrange(5)))) for i in range(120)]
    texts += [(2**53 + 1, "a" * 60 + "b"), (2**53 + 3, "a" * 60 + "c")]  # no float tells these from their neighbours
    texts += [(200, "a" * 300), (201, "a" * 49), (202, "a" * 130), (203, base[0] * 2), (203, base[0] * 2), (204, base[0] * 2), (None, base[0] * 2)] + odd
    want = brute_dedup([(t[0], common.text_bytes(t[1])) for t in texts])
    for hot in ({}, {"hot_chunks": 3, "hot_places": 2}, {"hot_chunks": 0}):
        got = suffixes.dedup(docs(texts), chunk_bytes=2000, shard_bytes=600, **hot).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert suffixes.dedup(docs([])).count() == 0


def test_op9_suffix_array():
    rnd = random.Random(3)
    for _ in range(60):
        t = bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(150)))
        assert suffixes.suffix_array(t, depth=8).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_op9_quicksort():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n, width, letters in ((0, 50, 2), (1, 50, 2), (500, 50, 2), (3000, 30, 3), (2000, 8, 2), (300, 13, 1)):
        rows = rnd.integers(0, letters, (n, width)).astype(np.uint8)
        group = np.sort(rnd.integers(0, 5, n))
        order, tied = suffixes.shallow_sort(rows, 32, group)
        want = sorted(range(n), key=lambda i: (group[i], rows[i, :32].tobytes()))
        assert [(group[i], rows[i, :32].tobytes()) for i in order] == [(group[i], rows[i, :32].tobytes()) for i in want]
        assert all((tied[k] == tied[k - 1]) == ((group[order[k]], rows[order[k], :32].tobytes()) == (group[order[k - 1]], rows[order[k - 1], :32].tobytes())) for k in range(1, n))
        assert [rows[i].tobytes() for i in suffixes.deep_shallow(rows, 8)[0]] == sorted(r.tobytes() for r in rows)


def brute_links(texts, words, num):
    sets = []
    for _, t in texts:
        w = WORD.findall(ascii_lower(t))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(texts):
        groups[find(k)].append(i)
    return sorted((i, len(sets[k]), min(groups[find(k)])) for k, (i, _) in enumerate(texts))


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_op10_brute(spark, docs, words, num):
    rnd = random.Random(words)
    base = [[f"w{rnd.randrange(400)}" for _ in range(n)] for n in (1, 2, 3, 12, 25, 60, 150, 400)]
    texts = []
    for i in range(260):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(30)}"
        texts.append((i, " ".join(w)))
    texts += [(900, None), (901, ""), (902, "Word"), (903, "word"), (904, "word")]
    got = sorted(tuple(r) for r in partenum.linked(docs(texts), words, num, 100).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_links(texts, words, num)


def test_op10_equal_fingerprints(spark, docs):
    """Different sets with one fingerprint stay apart, and ids beyond 2**53 beside a null stay what they are."""
    big = 2**53
    texts = [(big + 1 + 2 * i, " ".join(f"t{i // 2}w{j}" if j or i % 2 else f"other{i}" for j in range(40))) for i in range(40)] + [(None, "text without an id")]
    got = {r["doc_id"]: r["component_id"] for r in partenum.linked_rows(docs(texts), 3, 80, 100, bits=3).collect()}
    assert got == {i: None if i is None else big + 1 + 4 * (k // 2) for k, (i, _) in enumerate(texts)}


def test_op10_odd(spark, docs, odd):
    out = partenum.linked(docs(odd)).collect()
    assert len(out) == len(odd) and {(r["doc_id"], r["component_id"]) for r in out} >= {(1, 1), (2, 2), (4, 4), (5, 4)}
    assert partenum.linked(docs([])).count() == 0


def test_op10_blocks_of_a_bucket(spark, docs):
    """A bucket cut into blocks loses no pair."""
    texts = [(i, " ".join(f"w{k}" if k != i else f"x{i}" for k in range(120))) for i in range(40)]
    for block in (7, 2000):
        old = partenum.last_candidates.__defaults__
        partenum.last_candidates.__defaults__ = (block,)
        try:
            assert {r["component_id"] for r in partenum.linked(docs(texts), 3, 85, 100).collect()} == {0}
        finally:
            partenum.last_candidates.__defaults__ = old


def test_components(spark):
    rnd = random.Random(2)
    for edges in ([(rnd.randrange(60), rnd.randrange(60)) for _ in range(50)], [(i, i + 1) for i in range(40)], [(1, 1), (None, 2)]):
        root = list(range(100))
        real = [(a, b) for a, b in edges if a is not None and a != b]

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in real:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        got = {(r["node"], r["root"]) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {(x, find(x)) for e in real for x in e}


PAGE = "<html><head><title>T</title><script>x('<p>')</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav><main><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n text<p>Second<div class='comments'><p>Reader</div><form><p>Mail</form><aside>Side</aside></article></main><footer>End</footer></body></html>"


def test_op1_blocks():
    assert " ".join(t for _, t in html.blocks_of(PAGE)) == "Head & line First bold text Second"
    assert html.blocks_of(None) == html.blocks_of("") == html.blocks_of("<!-- x --><script>a</script>") == []
    assert [t for _, t in html.blocks_of("plain &lt; text<br>more</p></div> &#x41;")] == ["plain < text", "more", "A"]
    assert [t for _, t in html.blocks_of("<article><p>a<article><p>b</article>c</article><![CDATA[x]]><p")] == ["a", "b", "c"]


def test_op1_host_boilerplate(spark):
    rows = [(i, f"http://A.com/{i}", f"<div>Home page of the site with news every day</div><p>unique text number {i} is here and {i * 7} more words follow {i + 3}</p><div>rights reserved by the owner of this site forever</div>", "z") for i in range(9)]
    rows += [(99, None, None, "z"), (98, "nonsense", PAGE, "z"), (97, "http://b.com/", "<p>a page that stands alone on its host and stays</p>", "z"), (97, "http://b.com/", "<p>a page that stands alone on its host and stays</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert got[3] == "unique text number 3 is here and 21 more words follow 6" and got[99] == "" and got[98].startswith("Head & line") and got[97] == "a page that stands alone on its host and stays"
    assert html.extract(pages.where("false")).count() == 0


def test_op1_articles_are_judged(spark):
    """Boilerplate inside articles goes if its host's articles repeat it, unlike headlines that lists of links repeat and
    passages inside paragraphs; the chrome of article pages counts against pages without an article."""
    links = "<div class='related'>" + "".join(f"<p>Headline of the story number {i} today</p>" for i in range(9)) + "</div>"
    page = "<nav><p>Home News Sport Culture Travel and more here</p></nav><main><h1>Headline of the story number {0} today</h1><div>Please support our work with a small gift</div><p>Unique text {0} cites please support our work with a small gift again {1}</p></main>"
    rows = [(i, f"http://a.com/{i}", page.format(i, 7 * i) + links) for i in range(9)]
    rows += [(50, "http://a.com/x", "<div>Home News Sport Culture Travel and more here</div><p>one open page with a text of its own</p>")]
    rows += [(60 + i, f"http://copies.com/{i}", "<article><p>the same article stands on all pages of this host</p></article>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (html.GROUP_BYTES, 9_000):  # one group, and two for the host a.com
        got = {r["page_id"]: (r["text"], r["n_removed_tokens"]) for r in html.extract(pages, group_bytes=group).collect()}
        assert [got[i] for i in range(9)] == [(f"Headline of the story number {i} today Unique text {i} cites please support our work with a small gift again {7 * i}", 8) for i in range(9)]
        assert got[50] == ("one open page with a text of its own", 8) and got[60] == ("the same article stands on all pages of this host", 0)


def test_op1_without_markup(spark):
    """Pages whose markup says nothing: the article is what the host's pages don't share."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    menu, foot, advert = [text(2) for _ in range(8)], text(14), text(9)
    bodies = {i: [text(rnd.randint(3, 60)) for _ in range(rnd.randint(1, 6))] for i in range(40)}
    html_of = lambda i: "".join(f"<div>{x}</div>" for x in [*menu, *bodies[i][:2], advert, *bodies[i][2:], foot])
    pages = spark.createDataFrame([(2**53 + 2 * i + 1, "http://plain.org/x", html_of(i)) for i in bodies] + [(None, "http://plain.org/x", html_of(0))], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html.extract(pages).collect()]
    want = [(2**53 + 2 * i + 1, " ".join(b)) for i, b in bodies.items()] + [(None, " ".join(bodies[0]))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_op1_near_copies_stay_whole(spark):
    """Versions of one article on many pages of a host are no boilerplate to each other."""
    body = [f"paragraph {i} of a long article that many pages of the host have in versions" for i in range(8)]
    pages = spark.createDataFrame([(i, "http://c.com/", "<article>" + "".join(f"<p>{x}" for x in [*body, f"version {i}"]) + "</article>") for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract(pages).collect()} == {" ".join([*body, f"version {i}"]) for i in range(9)}


def test_op1_groups_decide_nothing(spark):
    """A host's pages have one result, however many groups they are dealt into: boilerplate on three of many open pages, in
    more than half of the articles, and in just half of them."""
    rnd = random.Random(31)
    text = lambda n: " ".join(f"w{rnd.randrange(10_000)}" for _ in range(n))
    rare, pair, most, half = text(9), text(9), text(8), text(8)
    rows = [(i, "http://a.com/x", f"<div>{text(30)}</div>" + (f"<div>{rare}</div>" if i % 13 == 0 else "") + (f"<div>{pair}</div>" if i in (1, 2) else "")) for i in range(39)]
    rows += [(100 + i, "http://b.com/x", f"<article><p>{text(30)}" + (f"<p>{most}" if i < 11 else "") + (f"<p>{half}" if i >= 10 else "") + "</article>") for i in range(20)]
    rows += [(200 + i, "http://c.com/x", rnd.choice(["<article><p>{}<p>{}</article><nav>{}</nav>", "<p>{}<p>{}<p>{}"]).format(text(20), *rnd.choices([rare, pair, most, half], k=2))) for i in range(30)]
    pages = spark.createDataFrame([*rows, (300, "http://b.com/y", None), (301, "http://c.com/y", "")], "page_id long, url string, html string")
    got = [sorted(map(tuple, html.extract(pages, group_bytes=size).collect())) for size in (html.GROUP_BYTES, 2_000, 300)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 91
    texts = {r[0]: r[2] for r in got[1]}
    assert not any(rare in texts[i] for i in (0, 13, 26)) and pair in texts[1] and most not in texts[100] and half in texts[119]


def test_op1_suffix_array():
    """Places against brute force."""
    import numpy as np

    rnd = random.Random(8)
    for _ in range(60):
        streams = [np.array([rnd.randrange(3) for _ in range(rnd.randrange(1, 40))]) for _ in range(rnd.randrange(1, 7))]
        run, least = rnd.choice([2, 3, 5, 6]), rnd.choice([2, 3])
        have = collections.defaultdict(set)
        for i, s in enumerate(streams):
            for k in range(len(s) - run + 1):
                have[tuple(s[k : k + run])].add(i)
        want = [[k for k in range(len(s) - run + 1) if len(have[tuple(s[k : k + run])]) >= least] for s in streams]
        assert [x.tolist() for x in html.repeated_places(streams, run, least)] == want


def test_op1_odd_pages():
    """Deep, unbalanced and very long pages take time in proportion to their size."""
    deep = "<div>" * 30_000 + "core" + "</p></span>" * 30_000
    assert [t for _, t in html.all_blocks(deep)] == ["core"]
    assert " ".join(t for _, t in html.all_blocks("<p>word " * 50_000)).count("word") == 50_000


def test_op10_sketches():
    """Sketches never claim more differences than there are, and fold to those of smaller length."""
    import numpy as np

    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 2**63, 6000, dtype=np.int64).astype(np.uint64)
    for a, b in ((10, 12), (500, 540), (600, 3000), (2900, 3000)):
        x, y = np.unique(pool[:a]), np.unique(pool[b - a : b])
        differ = len(np.setxor1d(x, y))
        assert 0.4 * differ <= partenum.apart(partenum.sketch(x), partenum.sketch(y)) <= differ
