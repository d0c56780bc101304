"""Centroid clusters, the prefix trie and SimHash components, against plain loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import clustering, prefix_trie, simhash
from tests.conftest import DATA

VECTORS = "vec_id long, embedding array<float>, label int, row long, cluster string, delta array<long>"


def brute_clusters(vectors: list[tuple], k: int, rounds: int) -> list[tuple]:
    """Lloyd with all distances in each round, from (vec_id, integers)."""
    start = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"2:{v[0]}".encode()).hexdigest() if v[0] is not None else "", v[1]))
    cents = [list(v[1]) for v in start[:k]]
    for step in range(rounds + 1):
        own = []
        for _, q in vectors:
            own.append(min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents)))
        if step < rounds:
            for j in range(len(cents)):
                mine = [q for (_, q), (_, o) in zip(vectors, own) if o == j]
                if mine:
                    cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = defaultdict(int)
    for d, j in own:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(vectors, own))


def clusters_of(df, k=clustering.K, rounds=clustering.ROUNDS, dim=clustering.DIM):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clustering.cluster(df, k=k, rounds=rounds, dim=dim).collect())


def test_clusters_equal_lloyd(spark, table_of):
    rng = random.Random(4)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    data = [(i, [np.float32(x + rng.gauss(0, 0.6)).item() for x in rng.choice(centre)], 0, 1, "c", [5]) for i in range(400)]
    data += [(1000 + i, data[0][1], 0, 1, "c", None) for i in range(150)]  # a hot vector, and ties between equal starts
    data += [(None, data[3][1], None, None, None, None), (7, data[9][1], None, None, None, None), (2000, [1e30] * 8, 0, 0, "", None), (2001, [-(2.0**27)] * 8, 0, 0, "", None)]
    bad = [(3000, None, 0, 0, "", None), (3001, [1.0] * 7, 0, 0, "", None), (3002, [1.0] * 7 + [None], 0, 0, "", None), (3003, [1.0] * 7 + [float("nan")], 0, 0, "", None), (3004, [float("-inf")] * 8, 0, 0, "", None), (3005, [], 0, 0, "", None)]
    most = clustering.MOST
    kept = [(i, [max(-most, min(most, int(np.floor(x * 256.0)))) for x in v]) for i, v, *_ in data]
    assert clusters_of(table_of([*data, *bad], VECTORS, 5), 12, 5, 8) == brute_clusters(kept, 12, 5)


def test_clusters_of_few_and_no_vectors(spark, table_of):
    few = [(i, [float(i), 0.5], 0, 0, "", None) for i in range(3)]
    assert clusters_of(table_of(few, VECTORS, 2), 10, 2, 2) == brute_clusters([(i, [256 * i, 128]) for i in range(3)], 10, 2)
    assert clusters_of(table_of([], VECTORS, 1)) == [] and clusters_of(table_of([(1, None, 0, 0, "", None)], VECTORS, 1)) == []


@pytest.mark.parametrize("big", [False, True])
def test_delta_step_equals_all_distances(big):
    """Against changed centroids only: same owners and distances as against all, ties included."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, k, dim = 50, int(rng.integers(1, 9)), 3
        scale = 1 << 24 if big else 1
        x, c = rng.integers(-3, 4, (n, dim)) * scale, rng.integers(-3, 4, (k, dim)) * scale
        every = np.arange(k)
        d, own = clustering.nearest(x, c, every)
        fresh = c.copy()
        changed = np.flatnonzero(rng.random(k) < 0.5)
        fresh[changed] = rng.integers(-3, 4, (len(changed), dim)) * scale
        changed = np.flatnonzero((fresh != c).any(axis=1))
        got, want = clustering.reassigned(x, own, d, fresh, changed), clustering.nearest(x, fresh, every)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_bucketed_tables_are_dropped_and_meet_without_a_shuffle(spark, table_of):
    df = table_of([(i, [float(i % 7), 1.0], 0, 0, "", None) for i in range(50)], VECTORS)
    before = {t.name for t in spark.catalog.listTables()}
    clustering.cluster(df, k=3, rounds=1, dim=2).count()
    assert {t.name for t in spark.catalog.listTables()} == before
    with clustering._Bucketed(spark) as tables:
        a = tables.write(spark.range(100).withColumnRenamed("id", "row").repartition("row"), "a")
        b = tables.write(spark.range(100).withColumnRenamed("id", "row").repartition("row"), "b")
        plan = spark.table(a).join(spark.table(b).hint("shuffle_hash"), "row")._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Exchange" not in plan


TURNS = "conv_id long, turn long, role string, text string, path string, n long, edge int"


def brute_trie(rows: list[tuple]) -> list[tuple]:
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = [*own.get(base, [])[:h], *turns[h:]]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own_saved
            leaves[node[:d]] += not children[node]
    return sorted(
        (min(m), len(node), str(min(members[node[:-1]])) if node else "None", len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def trie_of(df):
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.trie(df).collect())


@pytest.mark.parametrize("seed,parts", [(1, 4), (2, 13), (3, 40), (4, 7)])
def test_trie_equals_loops(spark, table_of, seed, parts):
    """Few distinct turns, so that many prefixes are shared, and ranges down to a path or two."""
    rng = random.Random(seed)
    data = []
    for c in range(-30, 110):
        size = 60 if c % 37 == 0 else rng.randrange(1, 9)
        data += [(c, t, rng.choice(["user", "user", "assistant"]), rng.choice(["a b", "a b", "hi", "one two three"]), "p", 1, 2) for t in range(size)]
    data += [(200 + i, t, "user", f"hot {t}", None, None, None) for i in range(60) for t in range(5)]  # a hot conversation
    data += [(400 + i, t, "user", "deep", None, None, None) for i in range(0, 40, 20) for t in range(30 + i)]  # a long edge, with an end on it
    data += [(None, 1, "user", "x", None, None, None), (500, None, None, None, "", 0, 0), (500, 1, None, "y", "", 0, 0), (500, 1, "user", "  \t ", "", 0, 0), (501, 3, "user", "z " * 50_000, "", 0, 0), (501, 3, "user", "z " * 50_000, "", 0, 0)]
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_of(table_of(data, TURNS, 5)) == brute_trie(data)
    finally:
        spark.conf.set(setting, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_little(table_of):
    assert trie_of(table_of([], TURNS, 1)) == [] and trie_of(table_of([(None, 1, "u", "x", None, None, None)], TURNS, 1)) == []
    for data in ([(5, 0, "user", "x", None, None, None)], [(1, 0, "u", "x", "", 0, 0), (1, 1, "u", "y z", "", 0, 0)], [(0, 0, "u", "x y", "", 0, 0), (1, 0, "u", "x y", "", 0, 0), (3, None, None, None, "", 0, 0)]):
        assert trie_of(table_of(data, TURNS, 1)) == brute_trie(data)


def test_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    ids = spark.range(3000).select(F.when(F.col("id") % 5 == 0, "a").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("path_key"), (F.col("id") - 1000).alias("conv_id"))
    by = defaultdict(list)
    for r in ids.collect():
        by[r.path_key].append(r.conv_id)
    got = {r.path_key: r.ends_sha256 for r in prefix_trie.ends(ids.repartition(7)).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in by.items()}


def brute_fingerprint(text) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: list[int], radius: int) -> list[int]:
    above = list(range(len(fps)))

    def top(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_simhash_of_odd_rows(odd, odd_rows, empty):
    got = simhash.classes(odd).collect()
    fps = [brute_fingerprint(r[1]) for r in odd_rows]
    comp = brute_components(fps, 4)
    least = defaultdict(list)
    for r, c in zip(odd_rows, comp):
        least[c] += [r[0]] * (r[0] is not None)
    want = sorted((str(r[0]), f"{f:016x}", str(min(least[c], default=None))) for r, f, c in zip(odd_rows, fps, comp))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.classes(empty).count() == 0


def test_simhash_of_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components(fps, 4)
    want = {r.doc_id: (f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, comp)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()} == want


def test_pieces_of_a_text_hold_whole_words(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)) + "\x0b x\x85y " + "z" * 300 + " end"
    want = brute_fingerprint(text)
    for piece in (1, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == want and simhash.fingerprint(b"\t A b ") == brute_fingerprint("\t A b ")


@pytest.mark.parametrize("parts", [simhash.THREE, simhash.TWO])
def test_anchors_cover(parts):
    """Any two fingerprints within the radius meet at a home of one of them; anchors are within covering radius plus threshold."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    homes = np.stack([h for h, _ in simhash.anchors(x, parts)], axis=1)
    came = [set(row[row >= 0]) for row in np.concatenate([n for _, n in simhash.anchors(y, parts)], axis=1)]
    assert all(set(h) & c for h, c in zip(homes.tolist(), came))
    at = 0
    for blocks, (home, near) in zip(parts, simhash.anchors(x, parts)):
        size, limit = sum(blocks), sum(n > 1 for n in blocks) + 4 // len(parts)
        word = (x >> np.uint64(at)) & np.uint64((1 << size) - 1)
        at += size
        for w, row in zip(word.tolist(), near.tolist()):
            real = [a & ((1 << 40) - 1) for a in row if a >= 0]
            assert len(set(real)) == len(real) and all((a ^ w).bit_count() <= limit for a in real)


@pytest.mark.parametrize("parts", [simhash.THREE, simhash.TWO])
def test_links_equal_all_pairs(spark, tmp_path, parts):
    """A cloud around one fingerprint, chains, and strangers."""
    rng = random.Random(6)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    centre = rng.getrandbits(64)
    fps = {centre, 0, (1 << 64) - 1, *(flip(centre, rng.randrange(1, 9)) for _ in range(250)), *(rng.getrandbits(64) for _ in range(150))}
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain = flip(chain, 4)
        fps.add(chain)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    path = str(tmp_path / "v.parquet")
    spark.createDataFrame([(s, 1 + (f == centre)) for f, s in zip(fps, signed)], "fp long, n long").repartition(5).write.parquet(path)
    root = {r.v: r.root for r in simhash.linked(spark.read.parquet(path), parts=parts).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for s, c in zip(signed, brute_components(fps, 4)):
        got[root.get(s, s)].add(s)
        want[c].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
