"""Generations of an index: written apart, checked, then made current by one pointer; changes found by manifests.

A generation is a folder ``builds/<id>`` of Parquet tables.  ``current.json`` names the active one and the one before it.
The pointer is written last, to another name first, so a reader sees a whole generation or the old one.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORMAT, POLICIES = 3, (1, 2)


class Conflict(RuntimeError):
    """Another writer published meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect()))  # one small file

    def _write(self, name: str, value: dict) -> None:
        tmp = self._path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(json.dumps(value, sort_keys=True).encode())
        out.close()
        # one step that replaces: a reader sees the old file or the new one, also if this process ends here
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(self._path(self._fs.makeQualified(tmp).toString()), self._path(self._fs.makeQualified(self._path(f"{self.root}/{name}")).toString()), how)

    def current(self) -> dict | None:
        return self._read("current.json")

    def lock(self, wait: float = 90.0, stale: float = 6 * 3600.0) -> str:
        """A lock that exactly one writer holds: creating its file without overwriting succeeds once.

        A lock older than ``stale`` seconds was left by a writer that ended; it is moved away, which also succeeds once.
        """
        p, until = self._path(f"{self.root}/.lock"), time.time() + wait
        while not self._fs.createNewFile(p):
            if self._fs.exists(p) and time.time() - self._fs.getFileStatus(p).getModificationTime() / 1000 > stale:
                gone = self._path(f"{self.root}/.lock.{uuid.uuid4().hex}")
                if self._fs.rename(p, gone):
                    self._fs.delete(gone, False)
                continue
            if time.time() > until:
                raise Conflict("another writer holds the lock")
            time.sleep(0.2)
        return f"{self.root}/.lock"

    def publish(self, tables: dict[str, DataFrame], manifest: dict, expected: str | None = "", check: bool = True) -> str:
        """Write a generation and make it current; ``expected`` is the id that must still be current ("" : any)."""
        if tables["chunks"].limit(1).count() == 0:
            raise ValueError("an empty index isn't published")
        held = self.lock()
        try:
            was = self.current()
            if expected != "" and (was or {}).get("build") != expected:
                raise Conflict(f"expected {expected}, found {(was or {}).get('build')}")
            build = uuid.uuid4().hex
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/builds/{build}/{name}")
            written = {name: self.spark.read.parquet(f"{self.root}/builds/{build}/{name}") for name in tables}
            faults = problems(written) if check else []
            if faults:
                self._fs.delete(self._path(f"{self.root}/builds/{build}"), True)
                raise ValueError("; ".join(faults))
            sums = {name: self._checksum(f"{self.root}/builds/{build}/{name}") for name in tables}
            self._write(f"builds/{build}/manifest.json".replace("/", "__"), {**manifest, "format": FORMAT, "build": build, "tables": sorted(tables), "artifacts": sums, "counts": {n: d.count() for n, d in written.items()}})
            self._write("current.json", {"build": build, "previous": (was or {}).get("build")})
            self._prune({build, (was or {}).get("build")})
            return build
        finally:
            self._fs.delete(self._path(held), False)

    def _checksum(self, folder: str) -> str:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        each = files.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("h")).orderBy("name").collect()  # a line for each file
        return ",".join(f"{r.name}:{r.h}" for r in each)

    def _prune(self, kept: set) -> None:
        for s in self._fs.listStatus(self._path(f"{self.root}/builds")):
            if s.getPath().getName() not in kept:
                self._fs.delete(s.getPath(), True)

    def manifest(self, build: str | None = None) -> dict | None:
        build = build or (self.current() or {}).get("build")
        return build and self._read(f"builds__{build}__manifest.json")

    def load(self, wanted: dict | None = None) -> dict[str, DataFrame]:
        """The tables of the current generation, once its files, manifest and contents have passed."""
        m = self.manifest()
        if not m:
            raise FileNotFoundError(f"no index under {self.root}")
        faults = incompatible(m, wanted or {})
        out = {}
        for name in m["tables"]:
            at = f"{self.root}/builds/{m['build']}/{name}"
            if self._checksum(at) != m["artifacts"][name]:
                faults.append(f"{name}: files differ from their checksums")
            out[name] = self.spark.read.parquet(at)
        faults += problems(out)
        if faults:
            raise ValueError("; ".join(faults))
        return out


def incompatible(manifest: dict, wanted: dict) -> list[str]:
    """Why an index can't be read by a configuration: format, chunk policy, and what both name but name differently."""
    out = [] if manifest.get("format") == FORMAT else [f"format {manifest.get('format')}"]
    if "chunk_policy" in manifest and manifest["chunk_policy"] not in POLICIES:
        out.append(f"chunk policy {manifest['chunk_policy']}")
    for key in ("encoder", "encoder_revision", "tokenizer", "ranking_mode", "chunk_policy", "stemming"):
        if key in wanted and manifest.get(key) != wanted[key]:
            out.append(f"{key}: {manifest.get(key)} in the index, {wanted[key]} asked for")
    return out


def problems(tables: dict[str, DataFrame]) -> list[str]:
    """What is wrong with a generation's tables (chunks; edges, postings, vectors where present): each check is a query that finds nothing."""
    chunks = tables["chunks"]
    ids = chunks.select("id")
    some = lambda df: bool(df.limit(1).count())
    out = []
    if some(chunks.groupBy("id").count().filter("count > 1 or id is null")):
        out.append("chunk ids repeat")
    if "basin_id" in chunks.columns:
        if some(chunks.filter("basin_id is null")):
            out.append("chunks without a basin")
        if some(chunks.select(F.col("basin_id").alias("id")).distinct().join(ids, "id", "left_anti")):
            out.append("basins without their attractor")
    if "successor" in chunks.columns and some(chunks.filter("successor is not null").select(F.col("successor").alias("id")).join(ids, "id", "left_anti")):
        out.append("successors that don't exist")
    if "edges" in tables:
        e = tables["edges"]
        if some(e.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti")):
            out.append("edges without their chunks")
    if "postings" in tables:
        p = tables["postings"]
        if some(p.filter("tf <= 0")) or some(p.select("id").distinct().join(ids, "id", "left_anti")):
            out.append("postings that no chunk has")
        if some(p.groupBy("id").agg(F.sum("tf").alias("n"), F.max("dl").alias("dl")).filter("n <> dl")):
            out.append("postings that don't add up to a length")
    if "vectors" in tables:
        v = tables["vectors"]
        width = v.select(F.size("vector").alias("w")).distinct()
        if width.limit(2).count() > 1 or some(v.filter(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))):
            out.append("vectors of several widths or not finite")
        if some(v.select("id").join(ids, "id", "left_anti")):
            out.append("vectors without their chunks")
    return out


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, state (new, changed, deleted, same, failed), sha256 to keep: old and new are source, sha256; new may have status.

    A source that failed keeps its old hash, so the next run tries it again; one that never was read keeps none.
    """
    if "status" not in new.columns:
        new = new.withColumn("status", F.lit("ok"))
    both = old.select("source", F.col("sha256").alias("was")).join(new.select("source", F.col("sha256").alias("now"), "status"), "source", "full_outer")
    state = (
        F.when(F.col("now").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "same").when(F.col("status") != "ok", "failed")
        .when(F.col("was").isNull(), "new").otherwise("changed")
    )
    out = both.withColumn("state", state)
    return out.select("source", "state", F.when(F.col("state") == "failed", F.col("was")).when(F.col("state") != "deleted", F.col("now")).alias("sha256"))


def refuse_changed(states: DataFrame) -> None:
    """Adding sources never replaces one: that is what a sync is for."""
    bad = states.filter("state = 'changed'").select("source").limit(5).collect()
    if bad:
        raise ValueError("already indexed with other contents: " + ", ".join(r.source for r in bad))


def same_manifest(a: DataFrame, b: DataFrame) -> bool:
    """Whether nothing moved between two listings: a source that changes while it is read spoils the snapshot."""
    return not a.select("source", "sha256").exceptAll(b.select("source", "sha256")).limit(1).count() and not b.select("source", "sha256").exceptAll(a.select("source", "sha256")).limit(1).count()


def merge(old: DataFrame, replaced: DataFrame, new: DataFrame) -> DataFrame:
    """Old chunks of sources that aren't replaced, and the new ones; of equal ids the new one stays.

    An empty result is refused, since publishing it would lose the index.
    """
    kept = old.join(replaced.select("source").distinct(), "source", "left_anti")
    both = kept.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    out = both.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__n")))).filter("__r = 1").drop("__n", "__r")
    if not out.limit(1).count():
        raise ValueError("an empty index isn't published")
    return out


def latest(rows: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """The newest row of each key: how appended state is read back."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), *[F.desc(c) for c in sorted(set(rows.columns) - {at, *keys})])
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def pending_summaries(basins: DataFrame, states: DataFrame, now: float, attempts: int = 3) -> DataFrame:
    """Basins (basin_id, fingerprint) whose summary is missing, outdated or due for another try; states: basin_id, fingerprint, status, attempts, retry_after."""
    out = basins.join(states, ["basin_id", "fingerprint"], "left")
    due = F.col("status").isNull() | ((F.col("status") == "failed") & (F.col("attempts") < attempts) & (F.coalesce("retry_after", F.lit(0.0)) <= now))
    return out.filter(due).select("basin_id", "fingerprint", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def retry_delay(attempt: int, longest: float = 60.0) -> float:
    return min(longest, 2.0**attempt)


def digest_of(rows: DataFrame, columns: list[str], place: int = 1000) -> DataFrame:
    """One row: rows and a hash of all of them that doesn't depend on their order.

    A row's place is a prefix of its hash.  Sorted hashes of a place are hashed, and the places' hashes again under shorter
    prefixes; a large table (its number of rows decides) begins with longer ones, so a place holds about ``place`` hashes.
    """
    line = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    n, chars = rows.count(), 3
    while 16**chars * place < n:
        chars += 2
    part = rows.select(line.alias("h")).groupBy(F.substring("h", 1, chars).alias("p"), "h").count()
    level = part.groupBy("p").agg(F.sum("count").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", F.col("count").cast("string")))), ","), 256).alias("h"))
    while chars > 3:
        chars -= 2
        level = level.groupBy(F.substring("p", 1, chars).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("digest"))


def unfinished(tasks: DataFrame, done: DataFrame, subset: str, protocol: str) -> DataFrame:
    """Tasks left of a run that was cut short; results of another subset or protocol don't count.  done: id, subset_id, protocol_id."""
    return tasks.join(done.filter((F.col("subset_id") == subset) & (F.col("protocol_id") == protocol)).select("id").distinct(), "id", "left_anti")


def leaderboard(scores: DataFrame, priority: tuple[str, ...] = ("ndcg_at_10", "map", "accuracy", "main_score")) -> str:
    """Scores (task, metric, value in 0 to 1) as a YAML list in percent; the first metric by priority is the main one.

    A few rows a task: the caller's report, not data.
    """
    out = []
    rows = scores.filter(~F.col("metric").startswith("nauc_") & F.col("value").isNotNull()).orderBy("task", "metric").collect()
    for task in dict.fromkeys(r.task for r in rows):
        mine = {r.metric: r.value for r in rows if r.task == task}
        main = next((m for m in priority if m in mine), None)
        out += [f"- task: {task}", "  metrics:"] + [f"  - type: {m}\n    value: {round(100 * v, 4)}" for m, v in sorted(mine.items(), key=lambda x: (x[0] != main, x[0]))]
    return "\n".join(out) + "\n"
