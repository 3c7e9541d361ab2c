"""Exact Jaccard self-join of documents' word shingles with PartEnum signatures, and its connected components.

Two sets of at least the wanted similarity whose sizes lie in one band, or in neighbouring ones, differ in at most k
features. The feature domain is cut into parts such that so similar sets agree in one of the parts (or, for small k, in
one of the subsets of a part's sub-parts); a signature is a hash of the features there. Sets that share a signature are
candidates, and each candidate is verified on the sets themselves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common
from quirelake.llm.components import components

#: Up to this k a part has three sub-parts, any two of which make a signature; beyond, a part is one.
ENUMERATED = 8
#: Bits of a parity sketch, at least; sketches rule candidates out before their sets are fetched.
SKETCH_BITS = 1024
#: Bits of the sketch that goes with each candidate pair at first; fewer, as most pairs differ widely.
MINI_BITS = 512
#: Members of a signature's bucket that one task compares; larger buckets are cut into blocks, each pair of which is a
#: task's share.
BLOCK = 2000


def bands(size: int, num: int, den: int) -> tuple[int, int, int]:
    """The band of a set size, and the largest size in it and in the next one. Bands begin where the last has ended;
    the largest size of a band is its smallest divided by the similarity."""
    band, low = 0, 1
    while True:
        high = low * den // num
        if size <= high:
            return band, high, (high + 1) * den // num
        band, low = band + 1, high + 1


def most_different(high: int, num: int, den: int) -> int:
    """k: how many features can be in only one of two sets of at most this size and at least the similarity."""
    return 2 * high * (den - num) // (den + num)


def parts_for(k: int) -> int:
    """Parts of the domain for large k, more than the k + 1 of which a set signs."""
    return math.ceil(1.45 * (k + 1))


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of one set of feature hashes (sorted, distinct).

    With n parts of which sets of the band may differ in k, two sets agree in n - k parts. For large k a set signs its
    k + 1 highest parts, by the number of features in them and then by a hash of these: of the parts in which two sets
    agree the highest stands above all but k parts of either, so both sign it. Low parts, which unlike sets share by
    chance, aren't signed, nor empty ones unless fewer than k + 1 are filled."""
    out = []
    band, high, next_high = bands(len(s), num, den)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(s + np.uint64(0x243F6A8885A308D3)), dtype=np.uint64)])
        for t, top in ((band, high), (band + 1, next_high)):
            k = most_different(top, num, den)
            if not k:
                continue
            seed = np.uint64(t) << np.uint64(40)
            if k <= ENUMERATED:
                n = (k + 2) // 2
                part = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
                sub = np.zeros((n, 3), np.uint64)
                np.add.at(sub, (part.astype(np.int64), (common.mix(s) % np.uint64(3)).astype(np.int64)), common.mix(s + np.uint64(0x243F6A8885A308D3)))
                for j, (a, b) in enumerate(combinations(range(3), 2)):
                    out.append(common.mix(common.mix(sub[:, a]) + common.mix(sub[:, b] + np.uint64(1)) + common.mix(seed + np.arange(n, dtype=np.uint64) * np.uint64(4) + np.uint64(j))))
            else:
                n = parts_for(k)
                part = (((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(part, np.arange(n + 1))
                own = common.mix(common.mix(sums[cut[1:]] - sums[cut[:-1]]) + common.mix(seed + np.uint64(1) + np.arange(n, dtype=np.uint64) * np.uint64(4)))
                out.append(own[np.lexsort((own, cut[:-1] - cut[1:]))[: k + 1]])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def shingle_set(text, words: int) -> np.ndarray:
    return np.unique(common.shingle_hashes(common.hash_words(common.words_of(text)), words))


def set_key(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set; bits: how many of the first are used."""
    with np.errstate(over="ignore"):
        a = common.mix(np.array([common.mix(s ^ np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
        b = common.mix(np.array([common.mix(s ^ np.uint64(0xA4093822299F31D0)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int((a >> np.uint64(64 - bits)).view(np.int64)[0]), int(b.view(np.int64)[0])


class Namer:
    """Names a set by its first fingerprint, or as other says where several sets have that one (see renamed())."""

    def __init__(self, bits: int = 64, other: dict[tuple[int, int], int] | None = None) -> None:
        self.bits, self.other = bits, other or {}

    def __call__(self, s: np.ndarray) -> int:
        key = set_key(s, self.bits)
        return self.other.get(key, key[0]) if self.other else key[0]


def renamed(classes: DataFrame, most: int = 1_000_000) -> dict[tuple[int, int], int]:
    """New names, by both fingerprints, for all but one of the sets that share a first fingerprint. Of n sets about
    n * n / 2 ** 64 do, a few hundred of 10 ** 11; many more mean that the hash is broken, which is an error."""
    twins = classes.groupBy("sid").agg(F.count("*").alias("n"), F.min("check").alias("stays")).where("n > 1")
    rows = classes.join(common.small_or_not(twins, 32), "sid").where("check <> stays").select("sid", "check").limit(most + 1).collect()
    if len(rows) > most:
        raise RuntimeError("too many shingle sets share a fingerprint")
    return {(r["sid"], r["check"]): int(common.mix(np.array([r["check"] ^ r["sid"]], np.int64).view(np.uint64)).view(np.int64)[0]) for r in rows}


def doc_sets(docs: DataFrame, words: int, bits: int = 64) -> DataFrame:
    """doc_id, text_key, n_shingles, sid, check: the two fingerprints identify a set. text_key tells rows apart that repeat
    a doc_id with another text."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for pdf in it:
            rows = []
            for t in pdf["text"]:
                s = shingle_set(t, words)
                rows.append((len(s), *set_key(s, bits)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n_shingles": [r[0] for r in rows], "sid": [r[1] for r in rows], "check": [r[2] for r in rows]})

    # ids travel as text, which no type of id and no null among them turns into floats
    out = docs.select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("text_key"), "text").mapInPandas(run, "doc_id string, text_key long, n_shingles long, sid long, check long")
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def first_candidates(docs: DataFrame, words: int, num: int, den: int, name: Namer) -> DataFrame:
    """a, b: for each signature its smallest set with each other one. Within an Arrow batch a signature is sent once:
    its other sets there are linked to the first right away, so a hot signature is thinned out before the shuffle."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for pdf in it:
            seen, sigs, sids = set(), [], []
            for t in pdf["text"]:
                s = shingle_set(t, words)
                if not len(s):
                    continue
                sid = name(s)
                if sid not in seen:
                    seen.add(sid)
                    sigs.append(signatures(s, num, den))
                    sids.append(np.full(len(sigs[-1]), sid))
            if not sigs:
                continue
            sig, sid = np.concatenate(sigs), np.concatenate(sids)
            by = np.lexsort((sid, sig))
            sig, sid = sig[by], sid[by]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            lead = sid[np.flatnonzero(first)[np.cumsum(first) - 1]]
            other = ~first & (lead != sid)
            pairs = np.unique(np.stack([lead[other], sid[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
            kept = np.flatnonzero(first)
            kept = kept[np.argsort(sid[kept], kind="stable")]  # rows of one set together: shuffle files compress by half
            yield pd.DataFrame({"sig": sig[kept], "a": sid[kept], "b": pd.array([pd.NA] * len(kept), dtype="Int64")})
            yield pd.DataFrame({"sig": np.zeros(len(pairs), np.int64), "a": pairs[:, 0], "b": pd.array(pairs[:, 1], dtype="Int64")})

    rows = docs.select("text").mapInPandas(run, "sig long, a long, b long")
    # rows with b only pass through: they are spread by a instead of meeting under one signature
    rows = rows.withColumn("sig", F.when(F.col("b").isNull(), F.col("sig")).otherwise(F.xxhash64("a", "b")))
    out = rows.withColumn("lead", F.expr("min(if(b is null, a, null)) over (partition by sig)"))
    out = out.select(F.when(F.col("b").isNull(), F.col("lead")).otherwise(F.col("a")).alias("x"), F.coalesce("b", "a").alias("y")).where("x <> y")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sets have den * intersection >= num * union, on the sets themselves. Sizes and sketches
    rule most others out before whole sets are moved."""
    left = sets.select(F.col("sid").alias("a"), F.col("features").alias("fa"), F.col("size").alias("na"), F.col("mini").alias("ma"), F.col("sketch").alias("ka"))
    right = sets.select(F.col("sid").alias("b"), F.col("features").alias("fb"), F.col("size").alias("nb"), F.col("mini").alias("mb"), F.col("sketch").alias("kb"))
    differ = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (differ * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
    sized = pairs.join(left.select("a", "na", "ma"), "a").join(right.select("b", "nb", "mb"), "b").where(near)
    sized = common.small_or_not(common.materialize(sized.select("a", "b", "na", "nb"), "partenum-sized", narrow=True), 64)
    sized = sized.join(left.select("a", "ka"), "a").join(right.select("b", "kb"), "b")

    def likely(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            differ = np.array([apart(x, y) for x, y in zip(pdf["ka"], pdf["kb"], strict=True)], dtype=np.int64)
            yield pdf.loc[differ * (den + num) <= (pdf["na"] + pdf["nb"]).to_numpy(np.int64) * (den - num), ["a", "b"]]

    close = common.materialize(sized.mapInPandas(likely, "a long, b long"), "partenum-likely", narrow=True)
    # only the sets of pairs that are left are moved
    rows = left.select("a", "fa").join(common.small_or_not(close, 32), "a")
    rows = rows.join(right.select("b", "fb").join(common.small_or_not(close.select("b").distinct(), 32), "b", "left_semi"), "b")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for pdf in it:
            ok = []
            for x, y in zip(pdf["fa"], pdf["fb"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(den * same >= num * (len(x) + len(y) - same))
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    return rows.mapInPandas(run, "a long, b long")


def sketch(s: np.ndarray) -> bytes:
    """The parity of how many features fall on each of some bits: SKETCH_BITS, doubled until there are two for each
    feature. The bits in which two sketches of one length differ are no more than the features in which their sets do."""
    bits = SKETCH_BITS
    while bits < 2 * len(s):
        bits *= 2
    at = common.mix(s ^ np.uint64(0x452821E638D01377)) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(k: bytes, size: int) -> bytes:
    """The same set's sketch of a smaller length: bits that then coincide are added up."""
    while len(k) > size:
        half = len(k) // 2
        k = (int.from_bytes(k[:half], "little") ^ int.from_bytes(k[half:], "little")).to_bytes(half, "little")
    return k


def apart(x: bytes, y: bytes) -> int:
    """In how many features two sets differ at least, from their sketches."""
    size = min(len(x), len(y))
    return (int.from_bytes(folded(x, size), "little") ^ int.from_bytes(folded(y, size), "little")).bit_count()


def buckets(sets: DataFrame, num: int, den: int, sketched: bool = False) -> DataFrame:
    """sig, sid, root of stored sets (sid, root, features), and size and sketch if wanted."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for pdf in it:
            for a in range(0, len(pdf), 50):
                part = pdf.iloc[a : a + 50]
                found = [np.frombuffer(f, "<u8") for f in part["features"]]
                sigs = [signatures(f, num, den) for f in found]
                n = [len(x) for x in sigs]
                out = pd.DataFrame({"sig": np.concatenate(sigs), "sid": np.repeat(part["sid"].to_numpy(np.int64), n), "root": np.repeat(part["root"].to_numpy(np.int64), n)})
                yield out.assign(size=np.repeat([len(f) for f in found], n), sketch=np.repeat(np.array([folded(sketch(f), SKETCH_BITS // 8) for f in found], dtype=object), n)) if sketched else out

    return sets.select("sid", "root", "features").mapInPandas(run, "sig long, sid long, root long" + ", size long, sketch binary" * sketched)


def possible(rows: pd.DataFrame, num: int, den: int, nearest: bool = False) -> np.ndarray:
    """Pairs (sid, sid) of rows with one sig, sorted by it, that are in different components and that neither their sizes
    nor their sketches rule out. Rows of all buckets are compared at once with those i places further on. nearest: of
    each set's pairs only the one with the most similar sketches."""
    sig, block, sid, root, size = (rows[c].to_numpy(np.int64) for c in ("sig", "block", "sid", "root", "size"))
    bits = np.frombuffer(b"".join(rows["sketch"]), "<u8").reshape(len(rows), -1)
    out, at = [], np.arange(len(rows))
    for i in range(1, len(rows)):
        at = at[at + i < len(rows)]
        at = at[sig[at] == sig[at + i]]
        if not len(at):
            break
        a = at[(root[at] != root[at + i]) & ((block[at] == 0) | (block[at + i] != block[at]))]
        b = a + i
        fit = den * np.minimum(size[a], size[b]) >= num * np.maximum(size[a], size[b])
        a, b = a[fit], b[fit]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        fit = differ * (den + num) <= (size[a] + size[b]) * (den - num)
        out.append(np.stack([sid[a[fit]], sid[b[fit]], differ[fit]], axis=1))
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    if nearest and len(found):
        both = np.concatenate([found, found[:, [1, 0, 2]]])
        both = both[np.lexsort((both[:, 1], both[:, 2], both[:, 0]))]
        found = both[np.flatnonzero(np.diff(both[:, 0], prepend=both[0, 0] - 1))]
    return found[:, :2]


def last_candidates(sets: DataFrame, num: int, den: int, nearest: bool, block: int = BLOCK) -> DataFrame:
    """a, b: pairs of sets of different components that share a signature and may be similar enough; with nearest, for
    each set and task the most likely one alone.

    Buckets with several components are compared pair by pair inside the tasks, and only what survives the sketches is
    passed on. A bucket larger than block is dealt into blocks by a hash of its sets; each two blocks, and each one
    alone, are a bucket of their own, so no task holds more than two blocks of a bucket."""
    mixed = buckets(sets, num, den).groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1 and n > 2").select("sig", "n")
    mixed = common.small_or_not(common.materialize(mixed, "partenum-mixed", narrow=True), 32)
    rows = buckets(sets, num, den, sketched=True).join(mixed, "sig")
    # block pairs (i, j), i <= j; block 0: the bucket is whole, or a block compared with itself; else 1 or 2
    blocks = F.ceil(F.col("n") / block).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    rows = rows.select(F.when(F.col("blocks") == 1, F.col("sig")).otherwise(F.xxhash64("sig", lo, hi)).alias("sig"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("long").alias("block"), "sid", "root", "size", "sketch")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        held = None
        for pdf in it:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) < 20_000:
                continue
            whole = held["sig"].to_numpy() != held["sig"].iloc[-1]  # the last bucket may go on
            if whole.any():
                yield frame(possible(held[whole], num, den, nearest))
                held = held[~whole].reset_index(drop=True)
        if held is not None and len(held):
            yield frame(possible(held, num, den, nearest))

    def frame(pairs: np.ndarray) -> pd.DataFrame:
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.repartition("sig").sortWithinPartitions("sig").mapInPandas(run, "a long, b long").distinct()


def linked(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked when den * intersection >= num * union of their shingle sets.

    component_id is the smallest doc_id that links reach. A text shorter than a shingle is one shingle; a null, empty
    or blank one has an empty set and is linked with nothing. Equal sets are one node of the graph, so a group of
    copies costs as much as one document. Rows that repeat a doc_id are documents of their own; a null
    doc_id belongs to the component of its equal texts, and a text that only null doc_ids have is linked with nothing.
    Other columns are ignored; an empty table gives no rows.

    No link between components is lost: candidates are found by complete signatures, first with one leader for each
    signature, then, between sets still in different components, with the most likely partner of each set, and at last in
    all pairs that share a signature."""
    return linked_rows(docs, words, num, den).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bits: int = 64) -> DataFrame:
    """linked() with text_key and root, a number of the component, by which components with one component_id differ; null
    for an empty set. bits: of the fingerprint that names a set; fewer only make the tests meet equal ones."""
    spark = docs.sparkSession
    every = common.materialize(doc_sets(docs, words, bits), "partenum-docs")
    classes = common.materialize(every.where("n_shingles > 0").groupBy("sid", "check", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "partenum-classes", narrow=True)
    name = Namer(bits, renamed(classes))
    if name.other:
        other = F.broadcast(spark.createDataFrame([(*k, v) for k, v in name.other.items()], "sid long, check long, other long"))
        every, classes = (df.join(other, ["sid", "check"], "left").withColumn("sid", F.coalesce("other", "sid")).drop("other") for df in (every, classes))
    pairs = common.materialize(first_candidates(docs, words, num, den, name), "partenum-candidates", narrow=True)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = classes.join(nodes, "sid").select("sid", F.col("rep").alias("doc_id")).where("doc_id is not null")

    def sets_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for pdf in it:
            rows = [(sid, shingle_set(t, words)) for sid, t in zip(pdf["sid"], pdf["text"], strict=True)]
            rows = [(sid, s) for sid, s in rows if len(s) and name(s) == sid]
            if rows:
                yield pd.DataFrame({"sid": [r[0] for r in rows], "size": [len(r[1]) for r in rows], "mini": [np.frombuffer(folded(sketch(r[1]), MINI_BITS // 8), "<i8") for r in rows], "sketch": [sketch(r[1]) for r in rows], "features": [r[1].tobytes() for r in rows]})

    texts = docs.select("doc_id", "text").join(common.small_or_not(common.materialize(wanted, "partenum-wanted", narrow=True), 64), "doc_id")
    sets = common.materialize(texts.mapInPandas(sets_of, "sid long, size long, mini array<long>, sketch binary, features binary"), "partenum-sets")
    if sets.groupBy("sid").count().where("count > 1").limit(1).count():  # rows that repeat a doc_id
        sets = common.materialize(sets.dropDuplicates(["sid"]), "partenum-sets", narrow=True)
    links = common.materialize(verified(pairs, sets, num, den), "partenum-links", narrow=True)
    tested = pairs
    for nearest in (True, False):
        roots = components(links, "partenum-components").withColumnRenamed("node", "sid")
        rooted = sets.join(common.small_or_not(roots, 32), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        more = common.materialize(last_candidates(rooted, num, den, nearest).join(tested, ["a", "b"], "left_anti"), "partenum-candidates", narrow=True)
        links = common.materialize(links.unionByName(verified(more, sets, num, den)), "partenum-links", narrow=True)
        tested = tested.unionByName(more)
    roots = components(links, "partenum-components")
    named = classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("members")), "root").where("members > 1").select("sid", "root", "component_id")
    out = every.join(named, "sid", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "sid")).alias("root"), F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return linked(common.table(spark, sf_dir, "documents"), words=3, num=90, den=100)


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
