"""Mixing, exact dedup and decontamination: the native operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import decontam, exact_dedup, mixing, near_dedup, queries, toxicity
from tests.conftest import DATA, rows
from tests.llm.conftest import words


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_exact_dedup_odd_rows(odd, odd_rows):
    got = exact_dedup.deduplicate(odd).collect()
    groups = defaultdict(list)
    for r in odd_rows:
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()].append(r[0])
    assert len(got) == len(odd_rows)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == set(groups)


@pytest.mark.parametrize("support", [0.5, 0.05, 1e-3])
def test_exact_dedup_hot_group(table_of, support):
    data = [(i, "hot" if i % 3 else f"t{i % 50}", None, None) for i in range(600)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(table_of(data), support=support).collect()}
    by = defaultdict(list)
    for i, t, _, _ in data:
        by[t].append(i)
    assert got == {i: (max(by[t]), len(by[t]), i == max(by[t])) for i, t, _, _ in data}


def test_heavy_hitters_are_all_found(table_of):
    data = [(i, "hot" if i < 40 else f"t{i}", None, None) for i in range(400)]
    fingerprints = exact_dedup.fingerprints(table_of(data))
    found = {bytes(r.digest) for r in exact_dedup.frequent(fingerprints, 0.05).collect()}
    assert hashlib.sha256(b"hot").digest() in found and len(found) <= 20


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, left, out = 1.5 * sum(sizes.values()), set(order), {}
    while left:
        share = total / sum(weight[s] for s in left)
        full = {s for s in left if share * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in left}
        out |= {s: 2 * sizes[s] for s in full}
        total -= sum(2 * sizes[s] for s in full)
        left -= full
    return out


def test_mixing(table_of):
    rng = random.Random(2)
    data = [(i, words(rng, rng.randrange(0, 60)) or None, None, rng.choice(["a", "b", "c", "ä", None, "a"])) for i in range(3000)]
    df = table_of(data)
    got = mixing.mixture(df).collect()
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in data}
    by = defaultdict(int)
    for d in data:
        by[d[3]] += size[d[0]]
    targets = brute_targets(by)
    source = {d[0]: d[3] for d in data}
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by[source[r.doc_id]] and abs(r.target - targets[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 2 * max(size.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(df).collect()))
    mixed = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert all(mixed[r.doc_id] * r.size == r.taken for r in got)


def test_mixing_odd_rows(odd, odd_rows, empty):
    got = mixing.mixture(odd).collect()
    assert len(got) == len(odd_rows) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mixture(empty).count() == mixing.mix(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def shingle_bag(text: str, width: int = 5) -> Counter:
    w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    width = min(width, len(w)) or 1
    return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if w else Counter()


def brute_matches(docs: list[tuple], items: list[tuple]) -> dict:
    """Best similarity of any item-sized window, over all windows."""
    out = {}
    for d in docs:
        w = [x for x in re.split(r"[^\w]+|_", (d[1] or "").lower()) if x]
        for i in items:
            bag = shingle_bag(i[1] or "")
            n = len([x for x in re.split(r"[^\w]+|_", (i[1] or "").lower()) if x])
            best = 0
            for s in range(max(1, len(w) - n + 1)):
                win = w[s : s + n]
                got = Counter(tuple(win[k : k + min(5, n)]) for k in range(len(win) - min(5, n) + 1)) if n else Counter()
                union = sum((got | bag).values())
                best = max(best, sum((got & bag).values()) / union if union else 0)
            if best >= 0.8:
                out[d[0], i[0]] = best
    return out


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_decontamination_equals_all_windows(spark, table_of, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(9)
    items = [(i, words(rng, n), None, None) for i, n in enumerate((40, 40, 25, 60, 7, 12, 3))] + [(90, "", None, None), (91, None, None, None)]
    docs = []
    for i in range(60):
        t = words(rng, rng.randrange(0, 200)).split()
        item = items[i % 7][1].split()
        if i % 3:
            for _ in range(i % 4):
                if len(item) > 12:
                    item[rng.choice([0, 1, len(item) - 1])] = "edit"
            at = rng.randrange(len(t) + 1)
            t = t[:at] + item + t[at:]
        docs.append((i, ", ".join(t).upper(), None, None))
    docs.append((60, items[0][1].rsplit(" ", 2)[0], None, None))  # shorter than the item
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(table_of(docs), table_of(items, "item_id long, text string, a string, b string")).collect()}
    want = brute_matches(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_decontamination_odd_rows(spark, odd, odd_rows, empty, table_of):
    items = table_of([(1, None), (2, ""), (3, "other text of the same id"), (None, odd_rows[5][1]), (3, "other text of the same id")], "item_id long, text string")
    got = decontam.matches(odd, items).collect()
    assert {r.doc_id for r in got if r.item_id == 3} == {5} and len([r for r in got if r.item_id is None]) == 4
    left = decontam.remove(odd, items)
    assert left.columns == odd.columns and left.count() == len(odd_rows) - 5
    assert decontam.matches(empty, items).count() == decontam.remove(empty, items).count() == 0
    assert decontam.matches(odd, items.where(F.lit(False))).count() == 0
    assert decontam.remove(odd, items.where(F.lit(False))).count() == len(odd_rows)


def test_index_finds_every_pair_within_the_radius_and_few_others(spark):
    rng = random.Random(4)
    items = [(i, 10, rng.getrandbits(64) - (1 << 63)) for i in range(400)]
    near = [(1000 + i, items[i % 400][2] ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(24)))) for i in range(1200)]
    far = [(5000 + i, rng.getrandbits(64) - (1 << 63)) for i in range(300)]
    index = decontam.index_of(spark.createDataFrame(items, "item long, m int, fp long"))
    windows = spark.createDataFrame([(10, k, fp) for k, fp in near + far], "m int, k long, fp long")
    distance = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    got = {(r.k, r.item) for r in decontam.candidates(windows, index).collect()}
    assert got == {(k, i) for k, fp in near + far for i, _, x in items if distance(fp, x) <= decontam.RADIUS}
    met = decontam.candidates(windows.where("k >= 5000"), index, 64).count()
    assert met / (len(items) * len(far)) < 0.25


def test_values_of_helper_named_columns_survive(spark, table_of):
    """Columns that are named like the operators' own keep their values."""
    rng = random.Random(12)
    docs = [(i, words(rng, 30), f"s{i % 3}", 777 + i, 888 + i, 999 + i, -i) for i in range(40)]
    docs += [(100 + i, docs[i][1], "s1", 1777 + i, 1888 + i, 1999 + i, -i) for i in range(5)]
    df = table_of(docs, "doc_id long, text string, source string, `__row` long, `__copies` long, `__copy` long, `row` long")
    items = table_of([(1, docs[7][1])], "item_id long, text string")
    whole = {d[0]: d for d in docs}
    for out in (mixing.mix(df), near_dedup.keep_one(df), decontam.remove(df, items), toxicity.keep_clean(df, toxicity.fit(df, table_of([(1, 1), (2, 0)], "doc_id long, toxic int")), threshold=1.1)):
        got = out.collect()
        assert out.columns == df.columns and got and all(tuple(r) == whole[r.doc_id] for r in got)


def test_mixing_of_null_and_equal_ids_is_spread_and_reruns_agree(spark, table_of):
    rng = random.Random(13)
    data = [(None if i % 2 else 5, words(rng, rng.randrange(1, 40)), None, "a") for i in range(2000)]
    results = [sorted(map(str, mixing.mixture(table_of(data, parts=p)).collect())) for p in (2, 7)]
    assert results[0] == results[1]
    cells = Counter(r.cell for r in mixing.celled(table_of(data).select(*[c.alias(k) for k, c in mixing.sized("doc_id", "text", "source").items()])).collect())
    assert max(cells.values()) < 20


def test_prefix_sums_beyond_64_bits(spark):
    rate, offset = (1 << 29) - 7, 12345
    ranks = [1, 5, 1 << 28, (1 << 28) + 1, 17_000_000_000, 10**12, 10**15]
    df = spark.createDataFrame([(k, rate, offset) for k in ranks], "k long, rate long, offset long")
    got = {r.k: r.n for r in df.select("k", mixing.crossed(F.col("k"), F.col("rate"), F.col("offset")).alias("n")).collect()}
    assert got == {k: ((offset + rate * k) >> 28) - ((offset + rate * (k - 1)) >> 28) for k in ranks}
