"""Size-tiered compaction of append-only shards under a versioned manifest. DataFrame operations only."""

from __future__ import annotations

import contextlib
import json
import math
import os
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common

#: Bytes of a finished file; runs below it are merged, files that reach it are left alone.
TARGET_BYTES = 64 * 1024 * 1024
#: Runs of similar size that are merged at once, also the ratio of neighbouring tiers.
FANOUT = 4
#: The smallest tier holds everything up to this size.
BASE_BYTES = 1024 * 1024
#: Arrivals that the query deals its table into: with a fanout of 4 they pass through three tiers.
ARRIVALS = 21


class CommitConflict(RuntimeError):
    """Another writer has committed the same version first."""


@dataclass
class ShardStore:
    """A folder of immutable Parquet runs; the manifest with the highest version says which of them are live.

    A run is one folder that one append or merge has written. A manifest lists the runs with their bytes and files,
    never their rows. Writers prepare files first and then create the next manifest by a step that fails if it exists, so
    a reader sees either the old or the new set, and a lost executor or driver leaves only unlisted files, which vacuum()
    removes. That step is a hard link on a local disk and elsewhere a rename without overwriting, which HDFS and other
    stores with atomic renames do in one step."""

    spark: SparkSession
    path: str
    target_bytes: int = TARGET_BYTES
    fanout: int = FANOUT
    base_bytes: int = BASE_BYTES

    def __post_init__(self) -> None:
        jvm = self.spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/_manifest"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/_manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest; version 0 is the empty store."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        stream = self._fs.open(self._path(f"{self.path}/_manifest/v{version:08d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, runs: list[dict]) -> dict:
        """Make runs the live set as the version after base, or raise CommitConflict if that version exists. Of several
        writers that try it at once, one succeeds."""
        new = {"version": base["version"] + 1, "runs": runs}
        draft = self._path(f"{self.path}/_manifest/.draft-{uuid.uuid4().hex}")
        final = self._path(f"{self.path}/_manifest/v{new['version']:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        try:
            self._create(draft, final)
        except (FileExistsError, Py4JJavaError) as e:
            if not self._fs.exists(final):
                raise
            raise CommitConflict(f"version {new['version']} is taken") from e
        finally:
            self._fs.delete(draft, False)
        return new

    def _create(self, draft, final) -> None:
        """final with the contents of draft, in one step that fails if final exists."""
        if self._fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        never = gateway.new_array(rename, 1)
        never[0] = rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, never)

    def _sizes(self, name: str) -> dict:
        sizes = [s.getLen() for s in self._fs.listStatus(self._path(f"{self.path}/{name}")) if s.getPath().getName().startswith("part-")]
        return {"name": name, "bytes": sum(sizes), "files": len(sizes)}

    def _write(self, df: DataFrame) -> dict:
        name = f"run-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self._sizes(name)

    def _add(self, runs: list[dict]) -> None:
        """Commit one version for each of runs; tried again if another writer came first."""
        for run in runs:
            while True:
                base = self.manifest()
                with contextlib.suppress(CommitConflict):
                    self.commit(base, [*base["runs"], run])
                    break

    def append(self, df: DataFrame) -> dict:
        """Add df as one new run and commit."""
        self._add([self._write(df)])
        return self.manifest()

    def append_arrivals(self, df: DataFrame, arrivals: int) -> dict:
        """Add the rows of df as that many runs, each with its own version, reading df once. Rows are dealt in turn within
        each task, so arrivals are alike in size whatever the rows hold."""
        staged = f"staged-{uuid.uuid4().hex}"
        column = next(c for c in (f"__arrival{i}" for i in range(len(df.columns) + 1)) if c not in df.columns)
        turn = F.pmod(F.monotonically_increasing_id(), F.lit(arrivals))
        df.withColumn(column, turn).write.option("compression", "zstd").partitionBy(column).parquet(f"{self.path}/{staged}")
        runs = []
        for i in range(arrivals):
            name, there = f"run-{uuid.uuid4().hex}", self._path(f"{self.path}/{staged}/{column}={i}")
            if self._fs.exists(there):
                self._fs.rename(there, self._path(f"{self.path}/{name}"))
            else:  # fewer rows than arrivals
                df.limit(0).coalesce(1).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
            runs.append(self._sizes(name))
        self._fs.delete(self._path(f"{self.path}/{staged}"), True)
        self._add(runs)
        return self.manifest()

    def tier(self, run: dict) -> int:
        """Runs whose mean file is as large as the target are done (-1); others fall into tiers by powers of fanout."""
        if run["files"] and run["bytes"] / run["files"] >= 0.75 * self.target_bytes:
            return -1
        return max(0, math.ceil(math.log(max(run["bytes"], 1) / self.base_bytes, self.fanout)))

    def compact(self, everything: bool = False) -> dict:
        """Merge the oldest fanout runs of a tier into files of the target size, until no tier holds as many; each merge
        is one commit. everything=True merges all unfinished runs at the end, for a read-mostly store.

        A merge moves no row between tasks: each task reads whole splits of the old files and writes one file, and there
        are as many tasks as the runs hold target sizes."""
        while True:
            tiers: dict[int, list[dict]] = {}
            live = self.manifest()
            for run in live["runs"]:
                tiers.setdefault(self.tier(run), []).append(run)
            full = [runs[: self.fanout] for t, runs in sorted(tiers.items()) if t >= 0 and len(runs) >= self.fanout]
            open_runs = [r for t, runs in tiers.items() if t >= 0 for r in runs]
            if not full and everything and len(open_runs) > 1:
                full = [open_runs]
            if not full:
                return live
            old = full[0]
            files = max(1, math.ceil(sum(r["bytes"] for r in old) / self.target_bytes))
            self.replace(old, self._write(self._read(old).coalesce(files)))

    def replace(self, old: list[dict], merged: dict) -> bool:
        """Commit merged in place of the runs old, whatever other writers have appended meanwhile. If one of old is no
        longer live, another writer has merged it: then merged is deleted, and the answer is False."""
        gone = {r["name"] for r in old}
        while True:
            base = self.manifest()
            if not gone <= {r["name"] for r in base["runs"]}:
                self._fs.delete(self._path(f"{self.path}/{merged['name']}"), True)
                return False
            with contextlib.suppress(CommitConflict):
                self.commit(base, [*(r for r in base["runs"] if r["name"] not in gone), merged])
                return True

    def vacuum(self, keep: int = 1, grace_s: float = 24 * 3600) -> int:
        """Drop all but the newest keep versions, and the runs that only those had; returns how many runs went. Those kept
        can still be read. Runs that no version lists go only if they are older than grace_s, as a writer may be about to
        commit them; 0 is for a store without other writers."""
        found = self.versions()
        stale = [self.manifest(v) for v in found[: -max(1, keep)]]
        live = {r["name"] for v in found[-max(1, keep) :] for r in self.manifest(v)["runs"]}
        listed = {r["name"] for m in stale for r in m["runs"]}
        for m in stale:
            self._fs.delete(self._path(f"{self.path}/_manifest/v{m['version']:08d}.json"), False)
        before = (time.time() - grace_s) * 1000
        dead = [s.getPath() for s in self._fs.listStatus(self._path(self.path)) if s.getPath().getName().startswith("run-") and s.getPath().getName() not in live and (s.getPath().getName() in listed or s.getModificationTime() <= before)]
        for p in dead:
            self._fs.delete(p, True)
        return len(dead)

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{r['name']}" for r in runs))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version that vacuum() has kept, by default the newest."""
        if version is not None and version not in self.versions():
            raise ValueError(f"version {version} isn't there, or no longer")
        runs = self.manifest(version)["runs"]
        if not runs:
            raise ValueError("the store is empty")
        return self._read(runs)


def size_tiered(docs: DataFrame, path: str, arrivals: int = ARRIVALS, **limits) -> ShardStore:
    """Store docs as that many arrivals, then compact.

    Every row of docs is stored once, whatever its columns hold: nulls, repeated rows, very long texts and columns of any
    name stay as they are. An empty table gives a store with one empty run per arrival, which compaction merges."""
    store = ShardStore(docs.sparkSession, path, **limits)
    store.append_arrivals(docs, arrivals)
    store.compact()
    store.vacuum(grace_s=0)
    return store


def op8_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, read back through the committed manifest: key, size and digest of each."""
    docs = common.table(spark, sf_dir, "documents")
    store = size_tiered(docs, common.new_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", F.length(text).cast("long").alias("n_chars_stored"), F.sha2(text, 256).alias("text_sha256"))


QUERIES = {"op8_size_tiered_compaction": op8_size_tiered_compaction}
ORACLES = {
    "op8_size_tiered_compaction": "SELECT doc_id, lang, source, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars_stored, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
}
