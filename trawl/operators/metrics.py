"""Retrieval metrics of all queries and cut-offs in one pass.

Three definitions are kept apart by name, since they differ:
``linear``  gains are grades, the ideal order is that of the retrieved grades;
``exp``     gains are 2^grade - 1, the ideal order is that of the first k;
``qrels``   gains are grades, the ideal order is that of all judged passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default cut-offs.
CUTS = (1, 3, 5, 10, 100)


def graded(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run`` (query_id, passage_id, rank) with grades; unjudged passages have grade 0."""
    return run.select("query_id", "passage_id", "rank").join(qrels.select("query_id", "passage_id", "grade"), ["query_id", "passage_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _discounted(gain: Column, rank: Column) -> Column:
    return gain / F.log2(rank + 1)


def _exp(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def per_query(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row per judged query with every metric; queries without results have zeros.

    Columns: n_relevant, rr, ap_retrieved (by retrieved relevant), ap_total (by
    all relevant), and for each cut k: dcg, dcg_exp, ndcg, ndcg_exp,
    ndcg_qrels, mrr, recall, precision (by k), precision_len (by what was
    returned, at most k).
    """
    best = qrels.where("grade > 0").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "passage_id")))
    counts = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("n_relevant"))
    return _measured(graded(run, qrels), counts, best, cuts)


def per_query_of_classes(run: DataFrame, asked: DataFrame, members: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """``per_query`` where the passages of a query's class are judged, itself excluded, without making these pairs.

    ``asked``: query_id and class, ``members``: passage_id, class and grade, each
    with distinct ids. Rows grow with the run and the members: a query needs
    the counts of its class and the class' highest grades, one more than the
    largest cut, since its own is left out.
    """
    asked = asked.select("query_id", "class").where("class is not null").distinct()
    members = members.select("passage_id", "class", "grade").where("class is not null")
    placed = run.select("query_id", "passage_id", "rank").join(asked, "query_id", "left").join(members, ["passage_id", "class"], "left")
    rows = placed.select("query_id", "passage_id", "rank", F.when(F.col("query_id") == F.col("passage_id"), 0).otherwise(F.coalesce("grade", F.lit(0))).alias("grade"))
    numbered = members.where("grade > 0").withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("grade")))).where(F.col("nth") <= max(cuts) + 1)
    tops = numbered.groupBy("class").agg(F.sort_array(F.collect_list("grade"), asc=False).alias("tops"))
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("grade") > 0).alias("relevant"))
    own = members.select(F.col("passage_id").alias("query_id"), "class", F.col("grade").alias("own"))
    known = asked.join(sizes, "class").join(tops, "class", "left").join(own, ["query_id", "class"], "left")
    known = known.where(F.col("judged") > F.when(F.col("own").isNotNull(), 1).otherwise(0))
    counts = known.select("query_id", (F.col("relevant") - F.when(F.col("own") > 0, 1).otherwise(0)).alias("n_relevant"))
    left_out = F.coalesce(F.array_position("tops", F.col("own")), F.lit(0)) - 1
    best = known.select("query_id", F.posexplode(F.filter("tops", lambda x, i: i != left_out)).alias("place", "grade"))
    return _measured(rows, counts, best.withColumn("place", F.col("place") + 1), cuts)


def _measured(rows: DataFrame, counts: DataFrame, best: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """Metrics of graded ``rows``; ``counts``: n_relevant of each judged query, ``best``: grade and place of the highest ones of each."""
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    hit = (F.col("grade") > 0).cast("int")
    rows = rows.withColumns({"hit": hit, "hits": F.sum(hit).over(by_rank), "ideal": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))})
    # The ideal order of the first k alone needs a number within each cut.
    for k in cuts:
        rows = rows.withColumn(f"ideal_{k}", F.when(F.col("rank") <= k, F.row_number().over(Window.partitionBy("query_id", F.col("rank") <= k).orderBy(F.desc("grade"), "rank"))))
    grade, rank = F.col("grade"), F.col("rank")
    sums = [
        F.count(F.lit(1)).alias("returned"),
        F.min(F.when(hit == 1, rank)).alias("first_hit"),
        F.sum(hit).alias("retrieved_relevant"),
        F.sum(F.when(hit == 1, F.col("hits") / rank).otherwise(0.0)).alias("ap_sum"),
    ]
    zero = F.lit(0.0)
    for k in cuts:
        top, ideal, ideal_k = rank <= k, F.col("ideal") <= k, F.col(f"ideal_{k}")
        sums += [
            F.sum(F.when(top, _discounted(grade, rank)).otherwise(zero)).alias(f"dcg_{k}"),
            F.sum(F.when(ideal, _discounted(grade, F.col("ideal"))).otherwise(zero)).alias(f"idcg_{k}"),
            F.sum(F.when(top, _discounted(_exp(grade), rank)).otherwise(zero)).alias(f"dcg_exp_{k}"),
            F.sum(F.when(top, _discounted(_exp(grade), ideal_k)).otherwise(zero)).alias(f"idcg_exp_{k}"),
            F.sum(F.when(top, hit).otherwise(0)).alias(f"hits_{k}"),
        ]
    found = rows.groupBy("query_id").agg(*sums)

    ideals = [F.sum(F.when(F.col("place") <= k, _discounted(grade, F.col("place"))).otherwise(zero)).alias(f"idcg_qrels_{k}") for k in cuts]
    judged = counts.join(best.groupBy("query_id").agg(*ideals), "query_id", "left").join(found, "query_id", "left")

    def over(a: Column, b: Column, most: bool = False) -> Column:
        value = F.when(b > 0, F.coalesce(a, F.lit(0)) / b).otherwise(zero)
        return F.least(value, F.lit(1.0)) if most else value

    n, returned = F.coalesce("n_relevant", F.lit(0)), F.coalesce("returned", F.lit(0))
    out = [
        F.col("query_id"),
        n.cast("int").alias("n_relevant"),
        F.coalesce(1 / F.col("first_hit"), zero).alias("rr"),
        over(F.col("ap_sum"), F.col("retrieved_relevant")).alias("ap_retrieved"),
        over(F.col("ap_sum"), n).alias("ap_total"),
    ]
    for k in cuts:
        hits = F.coalesce(f"hits_{k}", F.lit(0))
        out += [
            F.coalesce(f"dcg_{k}", zero).alias(f"dcg_{k}"),
            F.coalesce(f"dcg_exp_{k}", zero).alias(f"dcg_exp_{k}"),
            over(F.col(f"dcg_{k}"), F.col(f"idcg_{k}"), True).alias(f"ndcg_{k}"),
            over(F.col(f"dcg_exp_{k}"), F.col(f"idcg_exp_{k}")).alias(f"ndcg_exp_{k}"),
            over(F.col(f"dcg_{k}"), F.col(f"idcg_qrels_{k}"), True).alias(f"ndcg_qrels_{k}"),
            F.coalesce(F.when(F.col("first_hit") <= k, 1 / F.col("first_hit")), zero).alias(f"mrr_{k}"),
            over(hits, n).alias(f"recall_{k}"),
            (hits / k).alias(f"precision_{k}"),
            over(hits, F.least(returned, F.lit(k))).alias(f"precision_len_{k}"),
        ]
    return judged.select(*out)


def aggregate(by_query: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row of means over all judged queries; none where there are no judgments."""
    names = [f"{m}_{k}" for m in ("ndcg", "mrr", "recall", "precision") for k in cuts]
    return by_query.agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(n).alias(n) for n in names], F.avg("ap_retrieved").alias("map")).where("n_queries > 0")


#: Values among which the one at an index is found by sorting.
SORTED = 100_000


def index_percentile(df: DataFrame, value: str, share: float, by: str | None = None) -> DataFrame:
    """The value at index min(floor(share * n), n - 1) of the sorted values; nulls don't count.

    Without ``by`` a range that holds the index is narrowed by approximate
    quantiles and exact counts until it has SORTED rows or one value. With
    ``by`` equal values are counted first, so a group's rows are its distinct
    values.
    """
    known = df.where(F.col(value).isNotNull())
    if by:
        counted = known.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
        own = Window.partitionBy(by)
        up_to = F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        placed = counted.select(by, value, "n", up_to.alias("up_to"), F.sum("n").over(own).alias("all"))
        index = F.least(F.floor(F.col("all") * share), F.col("all") - 1)
        return placed.where((index >= F.col("up_to") - F.col("n")) & (index < F.col("up_to"))).select(by, value)
    n = known.count()
    place = min(int(share * n), max(n - 1, 0))
    inside, left, kind = known.select(value), n, known.schema[value].dataType
    while left > SORTED:
        at, spread = (place + 0.5) / left, 0.005
        low, high = inside.agg(F.percentile_approx(value, [max(0.0, at - spread), min(1.0, at + spread)], 10_000)).first()[0]
        below, within = inside.agg(F.sum((F.col(value) < F.lit(low).cast(kind)).cast("long")), F.sum(F.col(value).between(F.lit(low).cast(kind), F.lit(high).cast(kind)).cast("long"))).first()
        if not below <= place < below + within or within >= left:
            break  # the approximation was off; what is left is sorted
        inside, left, place = inside.where(F.col(value).between(F.lit(low).cast(kind), F.lit(high).cast(kind))), within, place - below
        if low == high:
            return inside.limit(1)
    return inside.orderBy(value).offset(place).limit(1)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin and n of values between 0 and 1; 1 belongs to the last bin."""
    return df.groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def violations(metrics: DataFrame, names: list[str], ordered: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """Rows with a metric that is null or not within 0 and 1, or with columns of ``ordered`` that don't rise, as latency percentiles and interval bounds do."""
    bad = F.lit(False)
    for name in names:
        bad = bad | ~F.coalesce(F.col(name).between(0, 1), F.lit(False))
    for row in ordered:
        for low, high in zip(row, row[1:]):
            bad = bad | F.coalesce(F.col(low) > F.col(high), F.lit(False))
    return metrics.where(bad)
