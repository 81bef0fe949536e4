"""Near copies by SimHash, and by min-hashes beyond its reach, checked by the exact Jaccard similarity of their sets of word shingles.

Candidates share one of a set's keys. The SimHash of the set under each of
``simhash``'s covering masks is one, so of the pairs within ``RADIUS`` bits none
is missed. Pairs at the similarity asked for may be further apart (up to 11 bits
were seen), so there are ``BANDS`` more, each of ``ROWS`` min-hashes: a pair at
similarity s shares none with probability (1 - s^ROWS)^BANDS, 3e-8 at 0.8 and
less above. Every candidate group is then searched on whole shingle sets,
fetched for candidates alone, so no link rests on an estimate.

Distinct sets, not documents, are grouped; equal groups are searched once. A
group larger than ``chunk`` is searched in three steps. Its sets are dealt to
chunks, and links are searched within each. Then one set of each component that
has come about stands for it, and these are searched in the same way, which
joins the parts of a cluster. Last, the sets that are still outside the group's
largest component, if any, meet all its chunks, and links are searched between
sets of different components alone. So rows grow with the group, not with its
square, and no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .exact_dedup import id_filter, may_hold_ids
from .simhash import RADIUS, components, keep_stayers, label, masks

#: Words in a shingle.
WORDS = 5
#: Jaccard similarity from which documents are linked.
SIMILARITY = 0.8
#: Seed of the shingles' XXH64.
SEED = 42
#: Keys of a set that are made of min-hashes, and min-hashes in each.
BANDS, ROWS = 24, 3
#: Sets of a group that are dealt to one chunk (about).
CHUNK = 1024
#: Shingles hashed or counted at once.
STRETCH = 5_000

_DRAWN = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False)
_MIX, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 1], np.uint64)
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_MASKS = np.array(masks(list(range(64)), RADIUS), np.uint64)


def shingles(text: bytes | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of all its words if they are fewer, a lone zero if there are none."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()  # on bytes: A-Z alone, and just the six white-space bytes
    if not parts:
        return np.zeros(1, np.uint64)
    joined = {b" ".join(parts)} if len(parts) < words else set(map(b" ".join, zip(*(parts[k:] for k in range(words)))))
    return np.unique(np.fromiter((xxh64_intdigest(s, seed) for s in joined), np.uint64, len(joined)))


def set_print(hashes: np.ndarray) -> int:
    """A signed long that names a set of shingles."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.astype("<u8").tobytes())).view(np.int64))


def set_prints(texts: list[bytes | None]) -> np.ndarray:
    """The names of the texts' sets, as unsigned 64-bit numbers."""
    return np.array([set_print(shingles(t)) for t in texts], np.int64).view(np.uint64)


def set_simhash(hashes: np.ndarray) -> np.uint64:
    """SimHash of a set: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STRETCH):
        ones += np.unpackbits(hashes[k : k + STRETCH].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ((2 * ones > len(hashes)) * _BITS).sum(dtype=np.uint64)


def simhash_keys(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set under each mask, as signed longs: sets within ``RADIUS`` bits share one or more."""
    return (set_simhash(hashes) & _MASKS).view(np.int64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set that are made of min-hashes, as signed longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), STRETCH):
        np.minimum(least, ((hashes[k : k + STRETCH] ^ _MIX) * _TIMES).min(1), out=least)
    return (least.reshape(BANDS, ROWS) * _WEIGHTS).sum(1, dtype=np.uint64).view(np.int64)


def prints_and_keys(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the name of the set) and keys (of min-hashes, then of SimHash) of every row of ``docs``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            keys = pa.array([np.concatenate([band_keys(s), simhash_keys(s)]) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_print(s) for s in sets], pa.int64()), keys], names=["doc_id", "fp", "keys"])

    return _texts(docs).mapInArrow(made, "doc_id long, fp long, keys array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))


def forest(names: list[int], sets: list[np.ndarray], similarity: float = SIMILARITY, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links sets of at least ``similarity``; sets of equal ``roots`` count as linked.

    Shingles become numbers of four bytes within the group, and one set meets
    all that are left in one pass over them.
    """
    if len(sets) < 2:
        return []
    known = np.unique(np.concatenate(sets))
    codes = [np.searchsorted(known, s).astype(np.int32) for s in sets]
    sizes, held = np.array([len(s) for s in sets]), np.zeros(len(known), bool)
    number = np.unique(np.array(roots, np.int64), return_inverse=True)[1] if roots else None

    def laid(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([codes[k] for k in some] or [np.zeros(0, np.int32)]), np.cumsum(sizes[some]) - sizes[some]

    edges, left = [], np.arange(len(sets))
    flat, starts = laid(left)
    while len(left):
        front, reached = [int(left[-1])], set()
        left, flat, starts = left[:-1], flat[: starts[-1]], starts[:-1]
        while front and len(left):
            at = front.pop()
            if roots and roots[at] not in reached:
                reached.add(roots[at])
                own = number[left] == number[at]
                if own.any():
                    front += left[own].tolist()
                    left = left[~own]
                    flat, starts = laid(left)
                    if not len(left):
                        break
            held[codes[at]] = True
            shared = np.add.reduceat(held[flat], starts, dtype=np.int64)
            held[codes[at]] = False
            near = shared >= similarity * (sizes[at] + sizes[left] - shared) - 1e-9
            if near.any():
                found = left[near].tolist()
                edges += [(names[at], names[k]) for k in found]
                front += found
                left = left[~near]
                flat, starts = laid(left)
    return edges


def buckets_of(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """t, key and fp of every distinct set, and the size n and two sets of each key that more than one has."""
    nodes = prints.groupBy("fp").agg(F.first("keys").alias("keys"))
    keyed = nodes.select("fp", F.posexplode("keys").alias("t", "key"))
    return keyed, cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))


def _dealt(members: DataFrame, chunk: int, size: str = "n") -> DataFrame:
    """Distinct arrays ``fps`` of the ``members`` (t, key, fp) of each chunk; ``size``: of the group."""
    own = F.pmod(F.xxhash64("fp"), F.ceil(F.col(size) / chunk)).alias("own")
    return members.groupBy("t", "key", own).agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1).select("fps").distinct()


def groups(keyed: DataFrame, buckets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distinct arrays ``fps`` of sets that share a key; of a key with more than ``chunk`` sets, of each chunk."""
    pairs = buckets.where("n = 2").select(F.array("a", "b").alias("fps"))
    members = keyed.join(buckets.where("n > 2").select("t", "key", "n"), ["t", "key"])
    return pairs.unionByName(_dealt(members, chunk)).distinct()


def remaining(labelled: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """t, key, own, other, fp and root of large groups' sets (t, key, fp, root, n) in pairs of chunks: one of all sets, one of those outside the largest component.

    Groups of one component have none.
    """
    sizes = labelled.groupBy("t", "key", "root").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("n"))
    whole = sizes.groupBy("t", "key").agg(F.max_by("root", F.struct("held", "root")).alias("largest"), F.sum("held").alias("all"), F.max("held").alias("most"))
    whole = whole.where(F.col("all") > F.col("most")).select("t", "key", "largest", F.ceil(F.col("all") / chunk).alias("chunks"), F.ceil((F.col("all") - F.col("most")) / chunk).alias("others"))
    met = labelled.join(whole, ["t", "key"])
    every = met.select("t", "key", F.pmod(F.xxhash64("fp"), "chunks").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("other"), "fp", "root")
    outside = met.where("root <> largest").select("t", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("own"), F.pmod(F.xxhash64("fp"), "others").alias("other"), "fp", "root")
    return every.unionByName(outside).distinct()


def _sets(docs: DataFrame, prints: DataFrame, asked: DataFrame) -> DataFrame:
    """fp and hashes of the ``asked`` sets (fp), from one row's text each."""
    wanted = cut(prints.join(asked.select("fp").distinct(), "fp").groupBy("fp").agg(F.min("doc_id").alias("asked")))
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "asked"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(may_hold_ids(shared.value, batch.column(0))))
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_print(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp", "hashes"])

    return _texts(docs).mapInArrow(made, "fp long, hashes array<long>").groupBy("fp").agg(F.first("hashes").alias("hashes"))


def _searched(asked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of forests of the groups of ``asked`` (g, fp, root; a null root is the set's own)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, held, roots = None, [], [], []

        def edges() -> pa.RecordBatch:
            found = forest(names, held, similarity, roots if any(r is not None for r in roots) else None)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in slices(batches):
            for g, fp, root, hashes in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if g != group:
                    if held:
                        yield edges()
                    group, names, held, roots = g, [], [], []
                names.append(fp)
                roots.append(root)
                held.append(hashes.values.to_numpy(zero_copy_only=False))
        yield edges()

    # Groups come to a worker one after the other, row by row.
    whole = asked.join(sets, "fp").select("g", "fp", "root", "hashes").repartition("g").sortWithinPartitions("g")
    edges = whole.mapInArrow(made, "a long, b long")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, prints: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) whose components are those of all candidate pairs of sets of at least ``similarity``."""
    keyed, buckets = buckets_of(prints)
    grouped = cut(groups(keyed, buckets, chunk).withColumn("g", F.monotonically_increasing_id()))
    members = cut(keyed.join(buckets.where(F.col("n") > chunk).select("t", "key", "n"), ["t", "key"]))
    sets = _sets(docs, prints, grouped.select(F.explode("fps").alias("fp")).unionByName(members.select("fp")))
    none = F.lit(None).cast("long").alias("root")
    edges = _searched(grouped.select("g", F.explode("fps").alias("fp"), none), sets, similarity)
    if members.isEmpty():
        return edges
    def contracted(pairs: DataFrame) -> DataFrame:
        """Edges from each set to the root of its component."""
        return cut(components(pairs).select(F.col("node").alias("a"), F.col("root").alias("b")))

    def labelled(stars: DataFrame) -> DataFrame:
        roots = stars.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        return cut(members.join(roots, "fp", "left").select("t", "key", "fp", F.coalesce("root", "fp").alias("root"), "n"))

    stars = contracted(cut(edges))
    rooted = labelled(stars)
    standing = rooted.groupBy("t", "key", "root").agg(F.min("fp").alias("fp"))
    standing = cut(standing.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("t", "key"))).where("n > 1"))
    again = cut(_dealt(standing, chunk).withColumn("g", F.monotonically_increasing_id()))
    found = cut(_searched(again.select("g", F.explode("fps").alias("fp"), none), sets, similarity))
    if not found.isEmpty():
        stars = contracted(stars.unionByName(found))
        rooted = labelled(stars)
    rest = cut(remaining(rooted, chunk).select(F.xxhash64("t", "key", "own", "other").alias("g"), "fp", "root"))
    return stars.unionByName(_searched(rest, sets, similarity))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits, of the shingle set) and component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at least
    ``similarity``, the row's own included. Texts without words, null ones
    among them, share a set; texts of fewer words than a shingle have one, of
    all their words. Repeated rows stay and share a component; a null doc_id
    never names a component unless all its rows lack one. Very long texts are
    read whole. Other columns are ignored; an empty table gives no rows.
    """
    prints = cut(prints_and_keys(docs))
    return label(prints.select("doc_id", "fp"), lambda nodes: links(docs, prints, similarity, chunk))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest doc_id, with all their columns.

    Rows whose id belongs to no dropped row pass without another look at their text.
    """
    return keep_stayers(docs, near_copies(docs), set_prints)
