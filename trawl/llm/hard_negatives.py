"""Hard negatives of anchors by bit-sliced integer products.

A row's numbers are cut into bit planes, the sign's first. Read from the most
significant plane on, the planes read so far give a part of its product with an
anchor, and the planes left can add no more than an interval: each of them adds
its power of two times a sum of some of the anchor's numbers. After every plane
the intervals tighten, and rows whose interval can't qualify any longer are
dropped, so only few rows are read to the last plane, which gives exact scores.

The first planes, whose intervals are too wide to drop much, are taken in one
step: the product of anchors and rows with the numbers that these planes form.
The last SPARSE planes are taken one by one, for the pairs that are left, as
counts of common bits of the row's plane and each plane of the anchor.

Rows are dealt to chunks, and every anchor goes to each chunk, so a task holds a
chunk and some anchors at a time. Anchors are a stated share of the rows; what a
chunk returns are the best rows of each anchor, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, picked

#: What components are multiplied by before they are rounded down.
SCALE = 256
#: Numbers are held within this many bits and a sign; components beyond are as large as that.
MOST_BITS = 24
#: Planes that are taken one by one.
SPARSE = 3
#: Positives of an anchor, and negatives of each positive.
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score between which a negative's lies.
LOWEST, HIGHEST = 50, 95
#: Rows of a chunk at most (about), and rows below which no further chunk is made.
CHUNK, LEAST = 65_536, 2_048
#: Anchors and rows that are multiplied at once.
TILE, BLOCK = 512, 8_192

_NONE = np.iinfo(np.int64).min // 2


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, width and numbers of the rows of ``vectors`` (vec_id, label, embedding) that have a label and finite components alone."""
    rows = picked(vectors, vec_id="long", label="long", embedding="array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    most = float(1 << MOST_BITS)
    number = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))), F.lit(int(most))), F.lit(-int(most))).cast("int")
    kept = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", "label", F.size("embedding").alias("width"), F.transform("embedding", number).alias("numbers"))


def bit_planes(numbers: np.ndarray, planes: int) -> np.ndarray:
    """The last ``planes`` planes of numbers in two's complement: planes by rows by words of 64 bits, least significant first."""
    rows, width = numbers.shape
    padded = np.zeros((rows, -(-max(width, 1) // 64) * 64), np.int64)
    padded[:, :width] = numbers
    return np.stack([np.packbits(((padded >> p) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for p in range(planes)])


def planes_of(numbers: np.ndarray) -> int:
    """Planes that hold all ``numbers``, the sign's among them."""
    return 1 + int(max(numbers.max(initial=0), ~numbers.min(initial=0))).bit_length()


class Block:
    """Rows with ids (nulls last), labels and numbers, sliced."""

    def __init__(self, ids: pa.Array, labels: np.ndarray, numbers: np.ndarray, by_label: bool):
        missing = np.asarray(ids.is_null())
        names = np.asarray(ids.fill_null(0))
        order = np.lexsort((names, missing, labels) if by_label else (names, missing))
        self.ids, self.names, self.missing = ids.take(pa.array(order)), names[order], missing[order]
        self.labels, self.numbers = labels[order], numbers[order]
        self.sliced = bit_planes(self.numbers, SPARSE)
        self.high = self.numbers >> SPARSE << SPARSE


class Tile:
    """Anchors, sliced, with what their negative and positive numbers sum to."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray):
        self.ids, self.labels, self.numbers = ids, labels, numbers
        self.planes = planes_of(numbers)
        self.sliced = bit_planes(numbers, self.planes)
        self.weights = [1 << p for p in range(self.planes - 1)] + [-(1 << self.planes - 1)]
        self.low, self.up = np.minimum(numbers, 0).sum(1), np.maximum(numbers, 0).sum(1)

    def high_products(self, block: Block, anchors: np.ndarray, rows: slice) -> np.ndarray:
        """Products of anchors with the numbers that the rows' first planes form, in a type that holds them exactly."""
        a, x = self.numbers[anchors], block.high[rows]
        most = (np.abs(x).max(initial=0) + (1 << SPARSE)) * np.abs(a).sum(1).max(initial=0)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        return a.astype(kind) @ x.astype(kind).T

    def plane_products(self, block: Block, plane: int, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What one plane of rows adds to their products with anchors, pair by pair."""
        held = block.sliced[plane][rows]
        counts = lambda p: np.bitwise_count(self.sliced[p][anchors] & held).sum(1, dtype=np.int64)
        return sum(weight * counts(p) for p, weight in enumerate(self.weights)) << plane


class Best:
    """The best rows of each group: highest scores, then first rows."""

    def __init__(self, groups: int, most: int):
        self.most, self.size = most, groups
        self.groups = self.rows = self.scores = np.zeros(0, np.int64)

    def add(self, groups: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        groups, rows, scores = np.concatenate([self.groups, groups]), np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores])
        order = np.lexsort((rows, -scores, groups))
        order = order[_place(groups[order]) < self.most]
        self.groups, self.rows, self.scores = groups[order], rows[order], scores[order]

    def least(self) -> np.ndarray:
        """The score of the last place of each group that is full."""
        return _nth(self.groups, self.scores, self.most, self.size)


def _place(groups: np.ndarray) -> np.ndarray:
    """How many rows of its group stand before each of sorted rows."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups)


def _nth(groups: np.ndarray, values: np.ndarray, n: int, size: int) -> np.ndarray:
    """The ``n``-th largest value of each of ``size`` groups, where there is one."""
    order = np.lexsort((-values, groups))
    order = order[_place(groups[order]) == n - 1]
    out = np.full(size, _NONE)
    out[groups[order]] = values[order]
    return out


#: Which pairs may still qualify: anchors, rows, lower and upper bounds of their scores.
Keep = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def refine(tile: Tile, block: Block, anchors: np.ndarray, rows: np.ndarray, parts: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, rows and exact scores of the pairs that ``keep`` leaves after each of the last planes."""
    for plane in reversed(range(SPARSE)):
        parts = parts + tile.plane_products(block, plane, anchors, rows)
        rest = (1 << plane) - 1
        kept = keep(anchors, rows, parts + rest * tile.low[anchors], parts + rest * tile.up[anchors])
        anchors, rows, parts = anchors[kept], rows[kept], parts[kept]
    return anchors, rows, parts


def find_positives(tile: Tile, block: Block, most: int) -> Best:
    """The best ``most`` rows of each anchor's label with another id; ``block`` is sorted by label."""
    best, rest = Best(len(tile.ids), most), (1 << SPARSE) - 1
    for label in np.unique(tile.labels):
        own = np.flatnonzero(tile.labels == label)
        begin, end = np.searchsorted(block.labels, label), np.searchsorted(block.labels, label, "right")
        for at in range(begin, end, BLOCK):
            rows = slice(at, min(end, at + BLOCK))
            parts = tile.high_products(block, own, rows)
            others = (block.names[rows] != tile.ids[own, None]) | block.missing[rows]
            floor = best.least()
            if parts.shape[1] >= most:
                lower = np.where(others, parts + rest * tile.low[own, None].astype(parts.dtype), _NONE)
                floor[own] = np.maximum(floor[own], np.partition(lower, -most, axis=1)[:, -most].astype(np.int64))
            open_ = others & (parts + rest * tile.up[own, None].astype(parts.dtype) >= floor[own, None])
            a, r = np.nonzero(open_)

            def keep(a: np.ndarray, r: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
                return upper >= np.maximum(floor, _nth(a, lower, most, best.size))[a]

            best.add(*refine(tile, block, own[a], r + at, parts[a, r].astype(np.int64), keep))
    return best


def find_negatives(tile: Tile, block: Block, lows: np.ndarray, highs: np.ndarray, most: int) -> Best:
    """The best ``most`` rows of another label within each window of each anchor; ``lows`` and ``highs``: anchors by windows."""
    places = lows.shape[1]
    best, rest = Best(lows.size, most), (1 << SPARSE) - 1
    every = np.arange(len(tile.ids))
    for at in range(0, len(block.labels), BLOCK):
        rows = slice(at, min(len(block.labels), at + BLOCK))
        parts = tile.high_products(block, every, rows)
        floor = np.maximum(lows, best.least().reshape(lows.shape))
        # A row below the full places of a window, or above it, is out of it; out of all, it is out.
        alive = lows <= highs
        need = np.where(alive, floor, np.iinfo(np.int64).max // 2).min(1)[:, None]
        top = np.where(alive, highs, _NONE).max(1)[:, None]
        open_ = (block.labels[rows] != tile.labels[:, None]) & (parts + rest * tile.up[:, None].astype(parts.dtype) >= need) & (parts + rest * tile.low[:, None].astype(parts.dtype) <= top)
        a, r = np.nonzero(open_)

        def keep(a: np.ndarray, r: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            kept = np.zeros(len(a), bool)
            for place in range(places):
                sure = (lower >= lows[a, place]) & (upper <= highs[a, place])
                full = np.maximum(floor[:, place], _nth(a[sure], lower[sure], most, len(every)))
                kept |= (upper >= full[a]) & (lower <= highs[a, place])
            return kept

        a, r, scores = refine(tile, block, a, r + at, parts[a, r].astype(np.int64), keep)
        for place in range(places):
            within = (scores >= floor[a, place]) & (scores <= highs[a, place])
            best.add(a[within] * places + place, r[within], scores[within])
    return best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def _meet(rows: DataFrame, anchors: DataFrame, by_label: bool, found: Callable[[Tile, Block, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``found`` makes of every tile of ``anchors`` and every chunk of ``rows``, all as ``integers`` has them.

    ``anchors`` may have a column ``windows``, which ``found`` gets with the
    rest of the tile's rows. Vectors of other lengths never meet.
    """
    spark = rows.sparkSession
    size = rows.count()
    chunks = max(1, -(-size // CHUNK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST)))
    windows = "array<struct<place:int,positive_id:bigint,score:bigint>>"
    left = rows.select("width", F.pmod(F.xxhash64("vec_id", "numbers"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("kind"), "vec_id", "label", "numbers", F.lit(None).cast(windows).alias("windows"))
    right = anchors.select("width", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("kind"), "vec_id", "label", "numbers", (F.col("windows") if "windows" in anchors.columns else F.lit(None)).cast(windows).alias("windows"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for begin, end in zip([0, *edges], [*edges, len(keys)]):
                width, chunk, kind = keys[begin].tolist()
                part = batch.slice(begin, end - begin)
                if (width, chunk) != group:
                    group, held, block = (width, chunk), [], None
                if not kind:
                    held.append(part)
                    continue
                if block is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    block, held = Block(whole["vec_id"].combine_chunks(), np.asarray(whole["label"]), _matrix(whole["numbers"].combine_chunks(), width), by_label), []
                if block is not None:
                    for at in range(0, part.num_rows, TILE):
                        some = part.slice(at, TILE)
                        yield from found(Tile(np.asarray(some.column(3)), np.asarray(some.column(4)), _matrix(some.column(5), width)), block, some)

    dealt = left.unionByName(right).repartition("width", "chunk").sortWithinPartitions("width", "chunk", "kind")
    return dealt.mapInArrow(made, schema)


def positives(rows: DataFrame, anchors: DataFrame, most: int = POSITIVES) -> DataFrame:
    """anchor_id, place (from 1), positive_id and score of the best ``most`` rows of each anchor's label with another id."""

    def found(tile: Tile, block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        best = find_positives(tile, block, most)
        yield pa.RecordBatch.from_arrays([pa.array(tile.ids[best.groups]), block.ids.take(pa.array(best.rows)), pa.array(best.scores)], names=["anchor_id", "positive_id", "score"])

    each = _meet(rows, anchors, True, found, "anchor_id long, positive_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"))
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("anchor_id", "place", "positive_id", "score")


def negatives(rows: DataFrame, anchors: DataFrame, chosen: DataFrame, most: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the best ``most`` rows of another label for each of ``chosen``.

    A negative's score is at least ``lowest`` and at most ``highest`` percent of the positive's.
    """
    grouped = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("windows"))
    asked = anchors.join(grouped, anchors["vec_id"] == grouped["anchor_id"]).drop("anchor_id")

    def found(tile: Tile, block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        windows = batch.column(6).to_pylist()
        places = max(map(len, windows))
        names = [[w["positive_id"] for w in row] + [None] * (places - len(row)) for row in windows]
        scores = np.array([[w["score"] for w in row] + [-1] * (places - len(row)) for row in windows], np.int64)
        lows, highs = -(-lowest * scores // 100), highest * scores // 100
        best = find_negatives(tile, block, lows, highs, most)
        a, place = np.divmod(best.groups, places)
        names = pa.array([names[i][j] for i, j in zip(a.tolist(), place.tolist())], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(tile.ids[a]), pa.array(place), names, pa.array(scores[a, place]), block.ids.take(pa.array(best.rows)), pa.array(best.scores)], names=["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    each = _meet(rows, asked, False, found, "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, anchor: Column, *, scale: int = SCALE, per_anchor: int = POSITIVES, per_positive: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, label, embedding) for which ``anchor`` holds, by integer inner products.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score;
    see ``positives`` and ``negatives``. Rows without a label or vector, or
    with a null or non-finite component, take no part. Higher scores come
    first, ties by smaller vec_id, null ids last. Repeated rows count as often
    as they occur, but an anchor's id that repeats is one anchor, that of its
    least label and vector, and rows of its id aren't its positives. Vectors
    of different lengths never meet, empty ones score zero. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = integers(vectors, scale)
    anchors = cut(rows.where(anchor & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("label", "width", "numbers")).alias("own")).select("vec_id", "own.*"))
    chosen = cut(positives(rows, anchors, per_anchor))
    return negatives(rows, anchors, chosen, per_positive, lowest, highest)


def shifted_labels(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding; where vec_id is divisible by 7, the next of ten labels."""
    rows = picked(vectors, vec_id="long", label="long", embedding="array<double>")
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
