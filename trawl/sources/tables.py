"""Keyed tables of Parquet versions: upserts, skips, DDL and the experiment store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from .corpus import exists


#: Deltas up to which a table is read as it is; the next one is folded into the buckets.
MOST_DELTAS = 16
#: States, and what they name, that stay for readers.
KEPT_STATES = 3

_ROW_OF = "folder of the row"


class KeyedTable:
    """One row per key: buckets of rows, and the deltas that writes have added since.

    A write adds one folder with its own rows, or markers of deleted keys, so it
    costs what it changes; readers merge. Of a key's rows the highest by
    ``order`` counts, of equal ones the last written. ``compact`` folds the
    deltas into new versions of the buckets that they touch; so does a write
    that finds MOST_DELTAS of them, and another job may at any time.

    A state names all folders that count. It is a numbered file, made by a
    rename that fails if the number is taken; the loser applies its change to
    the newer state, so no write is lost on a store whose renames are atomic and
    don't overwrite. Readers see one state or another, and the folders of the
    last KEPT_STATES stay for those that still read them.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "passage_id", order: str | None = None, buckets: int = 16):
        self.spark, self.folder, self.schema, self.key, self.order, self.buckets = spark, folder, schema, key, order, buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        conf = spark._jsc.hadoopConfiguration()
        root = hadoop.Path(folder)
        self._files = root.getFileSystem(conf)
        self._renames = hadoop.FileContext.getFileContext(root.makeQualified(self._files.getUri(), self._files.getWorkingDirectory()).toUri(), conf)
        self._plain = spark._sc._gateway.new_array(hadoop.Options.Rename, 0)

    # States

    def _numbers(self) -> list[int]:
        if not exists(self.spark, self.folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        return sorted(int(n[6:]) for n in names if n.startswith("state-"))

    def _load(self, number: int) -> dict:
        stream = self._files.open(self._path(f"{self.folder}/state-{number:09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _state(self) -> dict | None:
        """buckets; bases: the folder of each bucket that has rows; deltas: folders, the oldest first; batches: the last one of each stream."""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else None

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Replace the state by what ``change`` makes of it; False if that is None."""
        while True:
            numbers = self._numbers()
            made = change(self._load(numbers[-1]) if numbers else {"buckets": self.buckets, "bases": {}, "deltas": [], "batches": {}})
            if made is None:
                return False
            fresh, number = self._path(f"{self.folder}/fresh-{uuid.uuid4().hex}"), numbers[-1] + 1 if numbers else 0
            stream = self._files.create(fresh, False)
            stream.write(bytearray(json.dumps(made).encode()))
            stream.close()
            try:
                self._renames.rename(fresh, self._path(f"{self.folder}/state-{number:09d}"), self._plain)
                return True
            except Py4JJavaError as error:
                self._files.delete(fresh, False)
                if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                    raise

    def _clean(self) -> None:
        """Delete old states and the folders that only they name."""
        numbers = self._numbers()
        kept = [self._load(n) for n in numbers[-KEPT_STATES:]]
        named = {f for state in kept for f in [*state["bases"].values(), *state["deltas"]]}
        dropped = {f for n in numbers[:-KEPT_STATES] for state in [self._load(n)] for f in [*state["bases"].values(), *state["deltas"]]} - named
        for name in [*dropped, *[f"state-{n:09d}" for n in numbers[:-KEPT_STATES]]]:
            self._files.delete(self._path(f"{self.folder}/{name}"), True)

    def create(self, *, replace: bool = False) -> bool:
        """Make the table; False if it exists and stays."""
        self._files.mkdirs(self._path(self.folder))
        fresh = {"buckets": self.buckets, "bases": {}, "deltas": [], "batches": {}}
        missing = not self._numbers()
        return self._commit(lambda state: fresh if missing or replace else None)

    def drop(self) -> bool:
        """Delete the table; a missing one is no error."""
        return self._files.delete(self._path(self.folder), True)

    # Reading

    def _base(self, state: dict, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{v}/bucket={k}" for k, v in sorted(state["bases"].items()) if only is None or int(k) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _delta(self, state: dict) -> DataFrame:
        """The row or marker of each key that the deltas have."""
        every = None
        for number, name in enumerate(state["deltas"]):
            one = self.spark.read.schema(f"{self.schema}, deleted boolean").parquet(f"{self.folder}/{name}").withColumn(_ROW_OF, F.lit(number))
            every = one if every is None else every.unionByName(one)
        if every is None:
            return self.spark.createDataFrame([], f"{self.schema}, deleted boolean")
        order = [F.desc_nulls_last(self.order)] if self.order else []
        place = F.row_number().over(Window.partitionBy(self.key).orderBy(*order, F.desc(_ROW_OF)))
        return every.withColumn("place", place).where("place = 1").drop("place", _ROW_OF)

    def _merged(self, base: DataFrame, delta: DataFrame) -> DataFrame:
        """Rows of ``base`` that no row of ``delta`` replaces, and those of ``delta`` that no row of ``base`` outranks."""
        names = base.columns
        new = delta.select(F.col(self.key).alias("key of delta"), *([F.col(self.order).alias("order of delta")] if self.order else []))
        same = base[self.key].eqNullSafe(F.col("key of delta"))
        if not self.order:
            return base.join(new, same, "left_anti").unionByName(delta.where("not deleted").select(*names))
        outranks = F.col(self.order).isNotNull() & (F.col("order of delta").isNull() | (F.col(self.order) > F.col("order of delta")))
        old = base.join(new, same & ~outranks, "left_anti")
        held = base.select(F.col(self.key).alias("key of base"), F.col(self.order).alias("order of base"))
        beaten = delta[self.key].eqNullSafe(F.col("key of base")) & F.col("order of base").isNotNull() & (delta[self.order].isNull() | (F.col("order of base") > delta[self.order]))
        return old.unionByName(delta.join(held, beaten, "left_anti").where("not deleted").select(*names))

    def read(self) -> DataFrame:
        state = self._state()
        if state is None:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(self._base(state), self._delta(state)) if state["deltas"] else self._base(state)

    def count(self) -> int:
        return self.read().count()

    # Writing

    def upsert(self, rows: DataFrame, *, batch: tuple[str, int] | None = None) -> None:
        """Replace or add rows by key; the same rows again change nothing.

        ``batch``: a stream's name and the number of its batch; one that is not
        above the stream's last is left out, as its rows are in the table.
        """
        self._write(rows, False, batch)

    def delete(self, keys: DataFrame) -> None:
        """Delete the rows of ``keys``.

        With an order, a marker has that of ``keys``, or else that of the row
        that it deletes: rows of a lower one that come late stay deleted.
        """
        if self.order and self.order not in keys.columns:
            keys = keys.select(self.key).distinct().join(self.read().select(self.key, self.order), self.key)
        self._write(keys, True, None)

    def _write(self, rows: DataFrame, deleted: bool, batch: tuple[str, int] | None) -> None:
        self._files.mkdirs(self._path(self.folder))
        state = self._state()
        if batch and state and state["batches"].get(batch[0], -1) >= batch[1]:
            return
        names = self.spark.createDataFrame([], self.schema)
        order = [F.desc_nulls_last(self.order)] if self.order else []
        place = F.row_number().over(Window.partitionBy(self.key).orderBy(*order, F.to_json(F.struct(*rows.columns))))
        once = rows.withColumn("place", place).where("place = 1").drop("place")
        folder = f"d-{uuid.uuid4().hex}"
        names.unionByName(once, allowMissingColumns=True).select(*names.columns, F.lit(deleted).alias("deleted")).write.parquet(f"{self.folder}/{folder}")
        added = [] if self._empty(folder) else [folder]

        def change(state: dict) -> dict | None:
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                return None
            return state | {"deltas": [*state["deltas"], *added], "batches": state["batches"] | ({batch[0]: batch[1]} if batch else {})}

        if added or batch or state is None:
            self._commit(change)
        if len((self._state() or {"deltas": []})["deltas"]) > MOST_DELTAS:
            self.compact()

    def _empty(self, folder: str) -> bool:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{folder}").isEmpty()

    def compact(self) -> int:
        """Fold the deltas into the buckets that they touch; returns how many buckets were written."""
        state = self._state()
        if state is None or not state["deltas"]:
            return 0
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(state["buckets"])).cast("int")
        delta = self._delta(state)
        touched = sorted(r[0] for r in delta.select(bucket).distinct().collect())  # at most as many as buckets
        version = f"v-{uuid.uuid4().hex}"
        self._merged(self._base(state, touched), delta).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{version}")
        filled = {str(k): version for k in touched if exists(self.spark, f"{self.folder}/{version}/bucket={k}")}

        def change(now: dict) -> dict | None:
            if now["bases"] != state["bases"] or now["deltas"][: len(state["deltas"])] != state["deltas"]:
                return None  # another compaction or a new table came first
            return now | {"bases": {k: v for k, v in now["bases"].items() if int(k) not in touched} | filled, "deltas": now["deltas"][len(state["deltas"]) :]}

        if not self._commit(change):
            self._files.delete(self._path(f"{self.folder}/{version}"), True)
            return 0
        self._clean()
        return len(touched)

    def insert_absent(self, rows: DataFrame, by: str | None = None) -> int:
        """Add rows whose ``by`` value the table lacks; returns how many there were."""
        new = rows.join(self.read(), by or self.key, "left_anti").dropDuplicates([by or self.key])
        before = self.count()
        self.upsert(new)
        return self.count() - before


# The configurations that an experiment store starts with.
SEED_EXPERIMENTS = [
    ("bm25-baseline", "bm25", None),
    ("dense-baseline", "dense", None),
    ("hybrid-rrf", "hybrid", None),
    ("bm25-rerank", "bm25", "overlap"),
    ("hybrid-rerank", "hybrid", "overlap"),
]


class ExperimentStore:
    """Experiments, their results and their per-query metrics."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.experiments = KeyedTable(spark, f"{folder}/experiments", S.EXPERIMENTS, "experiment_id")
        self.results = KeyedTable(spark, f"{folder}/experiment_results", S.EXPERIMENT_RESULTS, "experiment_id")

    def seed(self) -> int:
        rows = [(str(uuid.uuid5(uuid.NAMESPACE_URL, name)), name, mode, model, json.dumps({"mode": mode}), [mode]) for name, mode, model in SEED_EXPERIMENTS]
        df = self.spark.createDataFrame(rows, "experiment_id string, name string, mode string, crossencoder_model string, config_json string, tags array<string>").withColumn("created_at", F.current_timestamp())
        return self.experiments.insert_absent(df, "name")

    def add(self, name: str, mode: str, config: dict, result: dict, by_query: DataFrame, *, reranker: str | None = None, number: str | None = None) -> str:
        """Store one run; returns its id. The same ``number`` again replaces the run."""
        number = number or str(uuid.uuid4())
        self.experiments.upsert(self.spark.createDataFrame([(number, name, mode, reranker, json.dumps(config, sort_keys=True), [mode])], "experiment_id string, name string, mode string, crossencoder_model string, config_json string, tags array<string>").withColumn("created_at", F.current_timestamp()))
        self.results.upsert(self.spark.createDataFrame([{**dict.fromkeys([f.split()[0] for f in S.EXPERIMENT_RESULTS.split(", ")]), **result, "experiment_id": number}], S.EXPERIMENT_RESULTS))
        by_query.select("query_id", "ndcg", "rr", "ap", "precision").write.mode("overwrite").parquet(f"{self._by_query}/experiment_id={number}")
        return number

    @property
    def _by_query(self) -> str:
        return f"{self.folder}/per_query_metrics/rows"

    def by_query(self) -> DataFrame:
        """Per-query metrics of all runs."""
        return self.spark.read.schema(S.PER_QUERY).parquet(self._by_query) if exists(self.spark, self._by_query) else self.spark.createDataFrame([], S.PER_QUERY)

    def counts(self) -> dict[str, int]:
        return {"experiments": self.experiments.count(), "experiment_results": self.results.count(), "per_query_metrics": self.by_query().count()}

    def joined(self) -> DataFrame:
        """Experiments with their results, the newest first."""
        return self.experiments.read().join(self.results.read(), "experiment_id", "left").orderBy(F.desc("created_at"), "name")

    def compared(self, a: str, b: str) -> DataFrame | None:
        """Both experiments' results in one row; None if either is missing."""
        left, right = (self.results.read().where(F.col("experiment_id") == n) for n in (a, b))
        if left.isEmpty() or right.isEmpty():
            return None
        return left.select(F.struct("*").alias("a")).crossJoin(right.select(F.struct("*").alias("b")))  # one row each

    def artifact(self, number: str, path: str) -> None:
        """One experiment as a JSON line."""
        self.joined().where(F.col("experiment_id") == number).write.mode("overwrite").json(path)
