"""What several corpus operators share: column handling and cutting lineage."""

from __future__ import annotations

import tempfile

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator of this package.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters one by one, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark alone, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast, and no others; of names that differ in case alone, the one that is spelled so."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])

    def place(name: str) -> int:
        return df.columns.index(name) if name in df.columns else [c.lower() for c in df.columns].index(name.lower())

    return plain.select(*[(plain[f"c{place(n)}"].cast("string").cast(t) if t == "binary" else plain[f"c{place(n)}"].cast(t)).alias(n) for n, t in types.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and all runs on one machine a folder of our own is made; elsewhere executors
    would not see it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif context.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="trawl-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows.

    The written rows outlive lost executors, and a loop's plan stays short.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_remainder(column, parts: int):
    """crc32 of an id's decimal text, modulo ``parts``: a split that any engine can repeat."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))


#: Rows of a few dozen bytes up to which a table may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it has at most ``rows`` rows.

    A larger one is returned as it is, and joins shuffle it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key of more than one row in so many is joined apart.
HOT_SHARES = 1000


def meet(large: DataFrame, small: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``large`` joined to ``small``, a written table with each ``key`` once, ``weight`` telling how many of ``large``'s ``total`` rows have it.

    Keys of more than a thousandth of the rows, a thousand at most, are
    broadcast, so their rows stay where they are; the others are dealt by key.
    """
    hot = F.broadcast(small.where(F.col(weight) > total / HOT_SHARES).drop(weight))
    return large.join(hot, key).unionByName(large.join(hot.select(key), key, "left_anti").join(small.drop(weight), key))


def let(value, body):
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


#: Rows of an Arrow batch between Spark and its Python workers; both sides hold batches whole, whatever their texts' lengths.
ARROW_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have ``ARROW_ROWS`` rows at most, or fewer if it asked for fewer.

    Plans take the setting when they run, so it stays in the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


#: Rows of an Arrow batch that become Python objects at once.
SLICE = 500


def slices(batches):
    """Batches cut into slices, so that a worker never holds the objects of a whole batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)


def stretches(batches, column: int, most: int):
    """Batches cut into runs of rows with at most ``most`` bytes in ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if k > start and held + size > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
