import random
import re
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from trawl.llm import near_copies as N


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_components(rows):
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if 10 * shared >= 8 * (len(sets[i]) + len(sets[j]) - shared):
            parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def made_rows():
    rng = random.Random(4)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(6, 200))]
        for k in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(99)}"
            rows.append((10 * g + k, " ".join(copy)))
    rows += [(3, "other words entirely"), (3, rows[0][1].upper()), (None, None), (None, ""), (900, "one two"), (901, "ONE\ttwo"), (None, "alone without id")]
    return rows


def test_components_equal_brute_force_in_one_and_in_many_chunks(spark):
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("keys", F.lit(1))
    for chunk in (N.CHUNK, 3):
        got = sorted(((r.doc_id, r.component_id) for r in N.near_copies(df, chunk=chunk).collect()), key=str)
        assert got == brute_components(rows), chunk
    assert N.near_copies(df.limit(0)).collect() == []


def test_the_stage_drops_copies_at_a_similarity_of_eight_tenths(spark, sf):
    """Copies far beyond three bits of SimHash: five words of 200 changed."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    copy, other = list(base), list(base)
    for at in (20, 60, 100, 140):
        copy[at] = "changed"
    for at in range(5, 200, 10):
        other[at] = "changed"
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(copy), "en", "s", 1), (3, " ".join(other), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = stage(spark, docs, sf)
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]] and kept.columns == docs.columns


def keyed_rows(spark, n):
    """Prints of ``n`` sets that share one key."""
    return spark.range(n).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("fp"), F.array(F.lit(7).cast("long")).alias("keys"))


def test_rows_of_a_large_group_grow_with_it(spark):
    """Each set is in one chunk; then only those outside the largest component meet the other chunks."""
    for n in (1_000, 10_000, 100_000):
        prints = keyed_rows(spark, n)
        keyed, buckets = N.buckets_of(prints)
        sizes = [r[0] for r in N.groups(keyed, buckets).select(F.size("fps")).collect()]
        assert sum(sizes) == n and max(sizes) < 1.25 * N.CHUNK
        labelled = keyed.withColumn("root", F.when(F.row_number().over(N.Window.orderBy("fp")) <= 50, F.col("fp")).otherwise(0)).withColumn("n", F.lit(n))
        rest = N.remaining(labelled)
        assert n <= rest.count() <= n + 50 * -(-n // N.CHUNK)
        assert N.remaining(labelled.withColumn("root", F.lit(0).cast("long"))).isEmpty()


def test_links_between_the_parts_of_a_large_group(spark):
    """A chain of near copies, each near its neighbours alone, a cluster and loners, in chunks of four."""
    rng = random.Random(5)
    base, rows = [f"w{k}" for k in range(120)], []
    words = list(base)
    for k in range(16):
        rows.append((k, " ".join(words)))
        words[(2 * k) % 120] = f"c{k}"
    for k in range(16):
        near = list(base)
        near[rng.randrange(120)] = f"n{k}"
        rows.append((100 + k, " ".join(near)))
        far = list(base)
        for at in range(rng.randrange(5), 120, 6):
            far[at] = f"f{k}"
        rows.append((200 + k, " ".join(far)))
    got = sorted(((r.doc_id, r.component_id) for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), chunk=4).collect()), key=str)
    assert got == brute_components(rows) and len({c for _, c in got}) > 5


def test_simhash_alone_links_all_copies_within_its_radius(spark):
    """Without the keys of min-hashes, every pair within three bits of the set's SimHash that is near enough is linked."""
    rng, rows = random.Random(6), []
    for g in range(30):
        base = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(300, 900))]
        rows += [(10 * g + k, " ".join([*base[: len(base) - k], *[f"v{g}" for _ in range(k)]])) for k in range(4)]
    rows.append((990, " ".join(f"u{k}" for k in range(12_000))))
    sets = [brute_set(t) for _, t in rows]

    def brute_simhash(shingles):
        from xxhash import xxh64_intdigest

        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [brute_simhash(s) for s in sets]
    assert [int(N.set_simhash(N.shingles(t.encode()))) for _, t in rows] == prints
    names = [N.set_print(N.shingles(t.encode())) for _, t in rows]
    near = {tuple(sorted((names[i], names[j]))) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3 and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = N.cut(N.prints_and_keys(df).withColumn("keys", F.expr(f"slice(keys, {N.BANDS} + 1, size(keys))")))
    assert keyed.select(F.size("keys")).distinct().collect() == [(15,)]
    roots = {r.node: r.root for r in N.components(N.links(df, keyed)).collect()}
    assert len(near) > 30 and all(a in roots and roots[a] == roots.get(b) for a, b in near)
