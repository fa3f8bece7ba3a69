"""Sorted key sets on disk: Parquet in delta encoding, written in steps that a manifest commits.

A store is a folder of parts, bucketed and sorted by key, and of manifests. A manifest names all
committed parts, the steps in each and how many rows these have; a commit writes the next one
beside the last and renames it into place, so it is there whole or not at all. Parts that no
manifest names are left-overs of a broken run: they are ignored, and ``sweep`` deletes them.
Readers see a missing store as empty.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}
#: What this process has put into the shared folder and not deleted: path, and the name of its table if it has one.
_made: dict[str, tuple[SparkSession, str | None]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")
    return _own.setdefault("path", "file://" + tempfile.mkdtemp(prefix="statespan-"))


def scratch_path(spark: SparkSession, label: str, table: str | None = None) -> str:
    """A new path in the shared folder, which ``scope``, ``release`` or the end of the process deletes."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}" if table is None else f"{shared_folder(spark)}/{table}"
    if not _made:
        atexit.register(release)
    _made[path] = (spark, table)
    return path


def release(but: set[str] | frozenset[str] = frozenset()) -> None:
    """Delete what this process still has in the shared folder, ``but`` some paths. Results that are
    read later would miss it."""
    for path in [p for p in _made if p not in but]:
        spark, table = _made.pop(path)
        try:
            if table and spark.sparkContext._jsc is not None:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)
        except Exception:  # the session's JVM may be gone at the end of the process
            if but:
                raise


@contextmanager
def scope() -> Iterator[None]:
    """What is put into the shared folder within the block goes with it, as soon as its results are
    written or collected there."""
    before = frozenset(_made)
    try:
        yield
    finally:
        release(before | {""})


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage and survives
    lost executors; ``discard`` deletes it, and so does the end of the process."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``saved`` tables that nothing reads any more."""
    for df in tables:
        if name := getattr(df, "_saved_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        _made.pop(df._saved_path, None)
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def write_sorted(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """A sorted set of rows by range of ``key``, delta-encoded."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, key).sortWithinPartitions(key)
    (ordered.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("compression", "zstd").parquet(path))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_verified(df: DataFrame, path: str, key: str) -> int:
    """Write beside ``path``, compare row for row, then put it in place; the number of rows."""
    spark, beside = df.sparkSession, f"{path}.new"
    write_sorted(df, beside, key)
    back = spark.read.schema(df.schema).parquet(beside)
    if not (df.exceptAll(back).isEmpty() and back.exceptAll(df).isEmpty()):
        raise ValueError(f"{beside} differs from what was written")
    target, source = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(beside)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    fs.rename(source, target)
    return spark.read.parquet(path).count()


@contextmanager
def setting(spark: SparkSession, **values) -> Iterator[None]:
    """Settings of the session (``__`` for a dot) that hold within the block only."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def merging(spark: SparkSession) -> Iterator[None]:
    """Within the block Spark takes the order of buckets as given, and merges distinct rows before it
    looks for them in buckets rather than after."""
    rules = "spark.sql.optimizer.excludedRules"
    late = ",".join(filter(None, [spark.conf.get(rules, None), "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"]))
    with setting(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__optimizer__excludedRules=late):
        yield


def bucketed(df: DataFrame, key: str, label: str, placed: bool = False) -> DataFrame:
    """``df`` written to the shared folder in as many buckets by the hash of ``key`` as there are
    shuffle partitions, each one sorted file, so that it joins by key without being moved or
    sorted; ``placed``: the rows lie so already. ``discard`` deletes it."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"statespan_{label}_{uuid.uuid4().hex}"
    path = scratch_path(spark, label, name)
    with merging(spark):
        (df if placed else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._saved_path, out._saved_table = path, name
    return out


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._new = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, inner: str = "") -> list[str]:
        at = self._new(f"{self.path}/{inner}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._new(f"{self.path}/{name}"))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        new, at = self._new(f"{self.path}/{name}.{uuid.uuid4().hex}"), self._new(f"{self.path}/{name}")
        stream = self.fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(new, at):
            raise OSError(f"{name} is there already")

    def delete(self, name: str) -> None:
        self.fs.delete(self._new(f"{self.path}/{name}"), True)


class Steps:
    """Committed steps of an iteration, sets of keys that are joined without being moved again.

    A part is a table in as many buckets by the hash of the key as there were shuffle partitions
    when the store began, each one sorted file; what is hashed into as many partitions meets it
    where it lies. Rows carry their step, so that parts can be merged.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.folder, self.key = Folder(spark, self.path), schema.fieldNames()
        self.parts, self.version = [], 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for name in reversed(self.folder.names("manifest")):
            if name.endswith(".json"):
                found = json.loads(self.folder.read(f"manifest/{name}"))
                self.version, self.buckets, self.parts = int(name[:-5]), found["buckets"], found["parts"]
                break

    def _swap(self, parts: list[dict]) -> None:
        """Make ``parts`` what the store holds; the manifest before the last stays for its readers."""
        self.folder.put(f"manifest/{self.version + 1:08d}.json", json.dumps({"buckets": self.buckets, "parts": parts}))
        self.version, self.parts = self.version + 1, parts
        for name in self.folder.names("manifest")[:-2]:
            self.folder.delete(f"manifest/{name}")

    def committed(self) -> list[int]:
        """Steps 0 to n, as far as the manifest has them without a gap."""
        have = {int(s) for p in self.parts for s in p["rows"]}
        out = []
        while len(out) in have:
            out.append(len(out))
        return out

    def _table(self, part: dict) -> DataFrame:
        """A part as a table in buckets, made known to the session if it isn't."""
        name = f"statespan_{part['folder'].replace('-', '_')}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            keys = ", ".join(f"`{k}`" for k in self.key)
            self.spark.sql(f"CREATE TABLE {name} ({columns}, step INT) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{part['folder']}'")
        return self.spark.table(name)

    def _write(self, df: DataFrame, label: str) -> dict:
        """Write (key, step) as a part."""
        folder = f"{label}-{uuid.uuid4().hex}"
        (df.write.bucketBy(self.buckets, *self.key).sortBy(*self.key).option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("compression", "zstd")
         .option("path", f"{self.path}/{folder}").saveAsTable(f"statespan_{folder.replace('-', '_')}"))
        return {"folder": folder}

    def unseen(self, df: DataFrame, steps: list[int]) -> DataFrame:
        """The distinct rows of ``df`` that stand in none of some steps. Only ``df`` is shuffled and
        sorted: parts are read bucket by bucket, in their order."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        new = (df if n == self.buckets else df.repartition(self.buckets, *self.key)).distinct()
        for part in self.parts:
            if wanted := sorted(set(map(int, part["rows"])) & set(steps)):
                seen = self._table(part)
                if len(wanted) < len(part["rows"]):
                    seen = seen.where(F.col("step").isin(wanted))
                new = new.join(seen.select(*self.key).hint("merge"), self.key, "left_anti")
        return new

    def commit(self, step: int, df: DataFrame, placed: bool = False) -> DataFrame:
        """Write a step, name it in the manifest with its number of rows, counted as they are
        written, and give it back. ``placed``: the rows come from ``unseen``, in their buckets."""
        seen = Observation()
        rows = df if placed else df.repartition(self.buckets, *self.key)
        rows = rows.select(*self.key, F.lit(step).alias("step")).observe(seen, F.count(F.lit(1)).alias("rows"))
        with merging(self.spark):
            part = self._write(rows, f"step-{step}")
        rest = [p | {"rows": {s: n for s, n in p["rows"].items() if int(s) != step}} for p in self.parts]
        self._swap([*(p for p in rest if p["rows"]), part | {"rows": {str(step): seen.get["rows"]}}])
        return self.read([step])

    def read(self, steps: list[int]) -> DataFrame:
        """The rows of some steps; none for no steps."""
        return self.read_steps(steps).drop("step")

    def read_steps(self, steps: list[int] | None = None) -> DataFrame:
        """The rows of some or all steps with their step."""
        schema = T.StructType([*self.schema.fields, T.StructField("step", T.IntegerType())])
        have = {p["folder"]: sorted(s for s in map(int, p["rows"]) if steps is None or s in steps) for p in self.parts}
        have = {f: s for f, s in have.items() if s}
        if not have:
            return self.spark.createDataFrame([], schema)
        whole = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in have])
        return whole.where(F.col("step").isin(sorted({s for x in have.values() for s in x})))

    def compact(self, steps: list[int], most: int = 4) -> bool:
        """Merge all but the largest of the parts of some steps into one if these are over ``most``.

        The merged part is written first; the manifest swap makes it count and drops the others in one
        stroke, so readers of either manifest see each row once."""
        own = [p for p in self.parts if set(map(int, p["rows"])) <= set(steps)]
        if len(own) <= most:
            return False
        largest = max(own, key=lambda p: sum(p["rows"].values()))
        gone = [p for p in own if p is not largest]
        rows = self.read_steps([int(s) for p in gone for s in p["rows"]])
        part = self._write(rows.repartition(self.buckets, *self.key), "merged")
        self._swap([*(p for p in self.parts if p not in gone), part | {"rows": {s: n for p in gone for s, n in p["rows"].items()}}])
        for p in gone:
            self._drop(p["folder"])
        return True

    def _drop(self, folder: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS statespan_{folder.replace('-', '_')}")
        self.folder.delete(folder)

    def sweep(self) -> list[str]:
        """Delete what no manifest names; the folders that went."""
        named = {p["folder"] for p in self.parts} | {"manifest"}
        gone = [n for n in self.folder.names() if n not in named]
        for n in gone:
            self._drop(n) if n.rpartition("-")[2].isalnum() else self.folder.delete(n)
        return gone

    def drop(self) -> None:
        """Delete the whole store."""
        for p in self.parts:
            self._drop(p["folder"])
        self.folder.delete("")

    def counts(self) -> DataFrame:
        """step, new and cumulative rows, as the manifest has them: no step is read."""
        new = {int(s): n for p in self.parts for s, n in p["rows"].items()}
        rows, total = [], 0
        for s in self.committed():
            total += new[s]
            rows.append((s, new[s], total))
        return self.spark.createDataFrame(rows, "step int, new bigint, cumulative bigint")


def convert(rows: DataFrame, path: str, part: str, at_once: int = 64, dry_run: bool = False, most: int | None = None) -> DataFrame:
    """Rewrite ``rows`` as one folder for each value of ``part``, ``at_once`` of them a job, and report
    them: the value, state (new, converted or pending), n_rows and n_wrong.

    A job replaces just its own folders, reads them back and compares them row for row; only then are
    they named in the progress file, so a call after a broken one does what is left. A part that differs
    raises. ``dry_run`` tells what would be done; ``most`` ends the call after so many parts."""
    spark, folder = rows.sparkSession, Folder(rows.sparkSession, path)
    files = [n for n in folder.names("_progress") if n.endswith(".json")]
    done = {r[part]: r for n in files for r in json.loads(folder.read(f"_progress/{n}"))}
    sizes = rows.groupBy(part).agg(F.count("*").alias("n_rows"))
    left = sizes.select(part).orderBy(part).toPandas()[part].tolist()  # values of a partition column, not rows
    left, new = [v for v in left if v not in done], set()
    for k in range(0, 0 if dry_run else len(left) if most is None else min(most, len(left)), at_once):
        own = left[k: k + at_once if most is None else min(k + at_once, most)]
        mine = rows.where(F.col(part).isin(own))
        with setting(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
            keys = [c for c in rows.columns if c != part]
            placed = mine.repartition(part, *keys).sortWithinPartitions(part, *keys)
            placed.write.mode("overwrite").partitionBy(part).option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("compression", "zstd").parquet(path)
        back = spark.read.schema(rows.schema).parquet(path).where(F.col(part).isin(own))
        both = mine.withColumn("sign", F.lit(1)).unionByName(back.withColumn("sign", F.lit(-1)))
        wrong = both.groupBy(*rows.columns).agg(F.sum("sign").alias("off"), F.count_if(F.col("sign") == 1).alias("n")).groupBy(part).agg(F.sum("n").alias("n_rows"), F.sum(F.abs("off")).alias("n_wrong")).collect()
        if bad := [r[part] for r in wrong if r["n_wrong"]]:
            raise ValueError(f"{part} {bad} differ from what was written")
        folder.put(f"_progress/{len(files):08d}.json", json.dumps([r.asDict() for r in wrong]))
        files.append("")
        new |= set(own)
        done |= {r[part]: r.asDict() for r in wrong}
    state = spark.createDataFrame([(r[part], "new" if r[part] in new else "converted", r["n_rows"], r["n_wrong"]) for r in done.values()], T.StructType([rows.schema[part], T.StructField("state", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("n_wrong", T.LongType())]))
    if new >= set(left):
        return state
    rest = sizes.join(state.select(part), part, "left_anti")
    return state.unionByName(rest.select(part, F.lit("pending").alias("state"), "n_rows", F.lit(None).cast("bigint").alias("n_wrong")))


def write_ladder(rows: DataFrame, path: str) -> None:
    """A ladder (step, nodes) as lines of text, the numbers parted by a space."""
    rows.select("step", "nodes").write.option("sep", " ").csv(path)


def read_ladder(spark: SparkSession, path: str) -> DataFrame:
    """A ladder (step, nodes) from lines of text; lines that are none are left out."""
    return spark.read.schema("step int, nodes bigint").option("sep", " ").option("mode", "DROPMALFORMED").csv(path)


def write_values(values: DataFrame, path: str) -> None:
    """Values as JSON lines."""
    values.write.json(path)


def bucket(key, bits: int = 39):
    """Range bucket by the high bits of a key."""
    return F.shiftright(key, bits)
