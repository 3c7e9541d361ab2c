"""Differences of packages as graphs of parts: digests of whole subtrees come from the leaves up, so equal subtrees cancel
before anything in them is compared."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.sources.store import stored

#: Relationship graphs deeper than this are an error: they have a cycle, or aren't packages.
DEEPEST = 64
#: A package with more parts and relations than this, both versions together, gets its digests by rounds of joins.
LARGE = 100_000
#: Rows of parts and relations that a kernel holds as Python objects at a time, if no single package has more.
AT_ONCE = 20_000


def _own():
    return F.sha2(F.concat_ws("\x1f", "kind", F.coalesce("content", F.lit("\x1e"))), 256)


def merkle(parts: DataFrame, relations: DataFrame, key: str = "package") -> DataFrame:
    """key, part, kind, own, digest of parts (key, part, kind, content) and relations (key, source, name, target).

    own is the digest of kind and content; digest also of the names and digests of the targets, in order of names, so it tells
    whole subtrees apart wherever they stand. Each round gives digests to the parts whose targets all have one: as many
    rounds as the graph is deep, each a join on part names and an aggregation with a map-side half. Targets that don't exist
    count as missing; a cycle is an error."""
    own = stored(parts.select(key, "part", "kind", _own().alias("own")), "parts")
    edges = stored(relations.select(key, F.col("source").alias("part"), "name", "target"), "relations")
    known = edges.join(own.select(key, F.col("part").alias("target"), F.lit(True).alias("there")), [key, "target"], "left")
    wait = known.where("there").select(key, "part", "target")
    done, left = None, own
    for _ in range(DEEPEST):
        open_ = wait if done is None else wait.join(done.select(key, F.col("part").alias("target")), [key, "target"], "left_anti")
        ready = left.join(open_.select(key, "part").distinct(), [key, "part"], "left_anti")
        below = ready.select(key, "part").join(known, [key, "part"])
        below = below.withColumn("digest", F.lit(None).cast("string")) if done is None else below.join(done.select(key, F.col("part").alias("target"), "digest"), [key, "target"], "left")
        new = stored(_digested(ready, below, key), "digests")
        left = left.join(new.select(key, "part"), [key, "part"], "left_anti")
        done = new if done is None else done.unionByName(new)
        if left.limit(1).count() == 0:
            return done
    raise ValueError("relations have a cycle, or are too deep")


def _digested(parts: DataFrame, below: DataFrame, key: str) -> DataFrame:
    child = F.concat_ws("\x1f", "name", F.coalesce("digest", F.concat(F.lit("missing "), "target")))
    listed = below.groupBy(key, "part").agg(F.array_sort(F.collect_list(child)).alias("children"))
    joined = parts.join(listed, [key, "part"], "left")
    return joined.select(key, "part", "kind", "own", F.sha2(F.concat_ws("\x1e", "own", F.array_join("children", "\x1e")), 256).alias("digest"))


def digests_of(parts: dict, links: dict, deepest: int) -> dict:
    """part -> digests of one package, as merkle() defines them. parts: part -> owns (one, unless a name is repeated); links:
    part -> its (name, target)."""
    waits, above, out = {}, defaultdict(list), {}
    for source, own in links.items():
        if source in parts:
            there = [t for _, t in own if t in parts]
            waits[source] = len(there)
            for t in there:
                above[t].append(source)
    ready = [p for p in parts if not waits.get(p)]
    for _ in range(deepest):
        following = []
        for p in ready:
            children = None
            if p in links:
                children = []
                for name, target in links[p]:
                    for digest in out.get(target) or [None if target is None else f"missing {target}"]:
                        children.append("\x1f".join(x for x in (name, digest) if x is not None))
                children = "\x1e".join(sorted(children))
            out[p] = [hashlib.sha256((own if children is None else f"{own}\x1e{children}").encode()).hexdigest() for own in parts[p]]
            for source in above.get(p, ()):
                waits[source] -= 1
                if not waits[source]:
                    following.append(source)
        if len(out) == len(parts):
            return out
        ready = following
    raise ValueError("relations have a cycle, or are too deep")


_LINKS = "array<struct<name: string, target: string>>"
_SIDES = ", ".join(f"{side}_kind string, {side}_own string, {side}_digest string, {side}_links {_LINKS}" for side in ("old", "new"))


def _rows(side: int, parts: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return parts.select(key, F.lit(side).alias("side"), "part", "kind", _own().alias("own"), none.alias("name"), none.alias("target")).unionByName(
        relations.select(key, F.lit(side).alias("side"), F.col("source").alias("part"), none.alias("kind"), none.alias("own"), "name", "target"))


def _compared_whole(rows: DataFrame, key: str, differing: bool) -> DataFrame:
    """compared() of packages that are one row each of Arrow batches. A row without a key or a part is related to nothing."""
    deepest = DEEPEST
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    listed = rows.groupBy(key, alone.alias("alone")).agg(F.collect_list(F.struct("side", "part", "kind", "own", "name", "target")).alias("rows")).select(key, "rows")

    def package(members):
        kinds, parts, links, nameless = {}, ({}, {}), ({}, {}), ([], [])
        for side, part, kind, own, name, target in members:
            if own is None:
                if part is not None:
                    links[side].setdefault(part, []).append((name, target))
            elif part is None:
                nameless[side].append((kind, own))
            else:
                parts[side].setdefault(part, []).append(own)
                kinds[side, part, own] = kind
        for own in parts:
            for part, owns in own.items():
                if len(owns) > 1:
                    owns.sort()
        a, b = (digests_of(p, x, deepest) for p, x in zip(parts, links, strict=True))
        for part in parts[0].keys() | parts[1].keys():
            for x, y, u, v in zip_longest(parts[0].get(part, ()), parts[1].get(part, ()), a.get(part, ()), b.get(part, ())):
                if u != v:
                    one = lambda side, own, digest: (None,) * 4 if own is None else (kinds[side, part, own], own, digest, links[side].get(part))  # noqa: E731, B023
                    yield (part, None if u is None or v is None else False, *one(0, x, u), *one(1, y, v))
                elif not differing:
                    yield (part, True, kinds[0, part, x], None, None, None, kinds[1, part, y], None, None, None)
        for side in (0, 1):
            for kind, own in nameless[side]:
                one = (kind, own, hashlib.sha256(own.encode()).hexdigest(), None)
                yield (None, None, *(one if side == 0 else (None,) * 4), *(one if side else (None,) * 4))

    def run(batches):
        link = pa.list_(pa.struct([("name", pa.string()), ("target", pa.string())]))
        kinds = [pa.string(), pa.bool_(), *[pa.string(), pa.string(), pa.string(), link] * 2]
        names = ["part", "equal", *(f"{side}_{c}" for side in ("old", "new") for c in ("kind", "own", "digest", "links"))]
        dicts = lambda x: None if x is None else [{"name": n, "target": t} for n, t in x]
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_pylist()
            at = 0
            while at < batch.num_rows:
                end, n = at + 1, sizes[at]
                while end < batch.num_rows and n + sizes[end] <= AT_ONCE:
                    n += sizes[end]
                    end += 1
                keys, flat = batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at).flatten()
                members = zip(*(c.to_pylist() for c in flat.flatten()), strict=True)
                found, owner = [], []
                for i, size in enumerate(sizes[at:end]):
                    new = list(package([next(members) for _ in range(size)]))
                    found += new
                    owner += [i] * len(new)
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                arrays = [pa.array([dicts(x) for x in c] if kind is link else c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int32())), *arrays], names=[key, *names])
                at = end

    return listed.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, part string, equal boolean, {_SIDES}")


def compared(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], key: str = "package", differing: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts of two versions side by side, and the relations of those that differ in either version.

    Parts: key, part, equal (whether the digests are; null where one version has no such part), kind, own and digest of
    merkle() with old_ and new_ before them; own and digest of equal parts may be null. differing: only parts that differ.
    All that a package has meets in one row, once, and goes through a kernel in batches; a package too large for that
    goes through merkle()'s rounds, with the same digests."""
    rows = _rows(0, *old, key).unionByName(_rows(1, *new, key))
    large = stored(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select(key), "large-packages")
    some = large.limit(1).count() > 0
    whole = _compared_whole(rows.join(large, key, "left_anti") if some else rows, key, differing)
    columns = [key, "part", "equal", *(f"{side}_{c}" for side in ("old", "new") for c in ("kind", "own", "digest"))]
    if not differing and not some:
        return whole.select(*columns), None, None
    whole = stored(whole, "both-versions")
    out = whole.select(*columns)
    links = [whole.where("not equal <=> true").select(key, F.col("part").alias("source"), F.explode(f"{side}_links").alias("x")).select(key, "source", "x.*") for side in ("old", "new")]
    if some:
        one = lambda df, side: df.select(key, "part", *[F.col(c).alias(f"{side}_{c}") for c in ("kind", "own", "digest")])
        a, b = (one(merkle(*(df.join(large, key, "left_semi") for df in v), key), side) for v, side in ((old, "old"), (new, "new")))
        rest = stored(a.join(b, [key, "part"], "full").withColumn("equal", F.col("old_digest") == F.col("new_digest")), "both-large-versions")
        rest = rest.where("not equal <=> true") if differing else rest
        out = out.unionByName(rest.select(*columns))
        these = rest.where("not equal <=> true").select(key, F.col("part").alias("source")).distinct()
        links = [x.unionByName(v[1].select(key, "source", "name", "target").join(these, [key, "source"], "left_semi")) for x, v in zip(links, (old, new), strict=True)]
    return out, *links


def package_changes(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], key: str = "package") -> DataFrame:
    """key, part, change, kind of two versions of packages, each (parts, relations) as for merkle().

    A part whose digest is the other version's cancels with all that is below it. What is listed stands at the highest node
    that differs by itself: added and removed parts whose source was there before (not all that they bring with them),
    modified content, and relations added, removed or retargeted at their source. A source that differs only through a
    target isn't listed, and a part that was moved to another name is renamed if its digest is unique among those that came and went; relations that
    follow it aren't retargeted."""
    differ, was, now = compared(old, new, key, differing=True)
    kind = F.coalesce("new_kind", "old_kind").alias("kind")
    modified = differ.where("old_own <> new_own").select(key, "part", F.lit("modified").alias("change"), kind)
    gone, fresh = differ.where("new_own is null"), differ.where("old_own is null")
    once = lambda df, c: df.groupBy(key, c).agg(F.min("part").alias("part"), F.count("*").alias("n")).where("n = 1").select(key, F.col(c).alias("digest"), F.col("part").alias(f"{c}_part"))
    renamed = stored(once(gone, "old_digest").join(once(fresh, "new_digest"), [key, "digest"]), "renamed")
    top = lambda lost, relations, name: _topmost(lost.select(key, "part", kind), relations, key).select(key, "part", F.lit(name).alias("change"), "kind")
    removed = top(gone.join(renamed.select(key, F.col("old_digest_part").alias("part")), [key, "part"], "left_anti"), was, "removed")
    added = top(fresh.join(renamed.select(key, F.col("new_digest_part").alias("part")), [key, "part"], "left_anti"), now, "added")
    moved = renamed.join(fresh.select(key, F.col("part").alias("new_digest_part"), kind), [key, "new_digest_part"])
    moved = _topmost(moved.select(key, F.col("new_digest_part").alias("part"), "kind"), now, key).select(key, "part", F.lit("renamed").alias("change"), "kind")
    stays = differ.where("old_own is not null and new_own is not null").select(key, F.col("part").alias("source"), F.col("new_kind").alias("kind"))
    x, y = (r.join(stays, [key, "source"], "left_semi") for r in (was, now))
    met = x.withColumnRenamed("target", "was").join(y.withColumnRenamed("target", "now"), [key, "source", "name"], "full").where("not was <=> now")
    met = met.join(renamed.select(key, F.col("old_digest_part").alias("was"), F.col("new_digest_part").alias("now")), [key, "was", "now"], "left_anti")
    change = F.when(F.col("was").isNull(), "relationAdded").when(F.col("now").isNull(), "relationRemoved").otherwise("retargeted")
    related = met.join(stays, [key, "source"]).select(key, F.concat_ws("#", "source", "name").alias("part"), change.alias("change"), "kind")
    return modified.unionByName(removed).unionByName(added).unionByName(moved).unionByName(related)


def _topmost(parts: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """parts that no other one of them has a relation to."""
    inner = parts.select(key, F.col("part").alias("source")).join(relations, [key, "source"]).select(key, F.col("target").alias("part")).distinct()
    return parts.join(inner, [key, "part"], "left_anti")
