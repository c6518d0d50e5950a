"""Sharding, centroid clustering and importance resampling against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from llm_cases import SF_DIR, hard_rows, make_docs  # noqa: F401

from terralux.llm import best_fit_sharding, hadamard_clustering, importance_resampling, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def against_sql(spark, name, tables, key):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df().sort_values(key).reset_index(drop=True)
    got = queries.QUERIES[name](spark, SF_DIR).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


# --- sharding


def best_fit(sizes, capacity):
    """Loads and places of best-fit decreasing, one group at a time."""
    free, places = [], []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(free) if room >= size]
        if fits:
            k = min(fits, key=lambda i: (free[i], i))
        else:
            k = len(free)
            free.append(max(capacity, size))
        free[k] -= size
        places.append(k)
    return free, places


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([11, 60, 400])
    sizes = [rng.randint(1, capacity + 3) if rng.random() < 0.5 else rng.choice([2, 3, 7]) for _ in range(300)]
    counts = Counter(sizes)
    order = sorted(counts, reverse=True)
    plan = best_fit_sharding.fit(order, [counts[s] for s in order], capacity)
    free, places = best_fit(sizes, capacity)
    assert plan.shards == len(free)
    got = [plan.targets[np.searchsorted(plan.starts, k, side="right") - 1] for k in range(len(sizes))]
    assert got == places
    assert best_fit_sharding.fit(order, [counts[s] for s in order], capacity, len(free) - 1) is None


def test_rooms_find_the_tightest():
    rng = random.Random(5)
    rooms, plain = best_fit_sharding.Rooms(), set()
    for step in range(3000):
        if plain and rng.random() < 0.4:
            gone = rng.choice(sorted(plain))
            plain.remove(gone)
            rooms.remove(*gone)
        else:
            new = (rng.randint(1, 50), step)
            plain.add(new)
            rooms.add(*new)
        size = rng.randint(1, 55)
        assert rooms.tightest(size) == min((x for x in plain if x[0] >= size), default=None)


def check_shards(rows, docs, shards):
    """Groups whole, slots gapless, sizes right."""
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    of, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        of[r.text_crc32, r["size"]].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [loads[k] for k in range(shards)]


def test_shards_of_corpus(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    rows = queries.QUERIES["op11_best_fit_sharding"](spark, SF_DIR).collect()
    loads = check_shards(rows, list(zip(docs.doc_id, docs.text, strict=True)), 24)
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 24


def test_large_group_stands_alone(make_docs):
    docs = [(k, "the same text " * 9) for k in range(400)] + [(1000 + k, f"text {k} " * (k % 7 + 1)) for k in range(800)]
    rows = best_fit_sharding.sharded(make_docs(docs, 5)).collect()
    loads = check_shards(rows, docs, 24)
    assert max(loads) == 400 * (14 * 9 + 8)
    rest = sorted(loads)[:-1]
    assert rest[-1] - rest[0] < 0.05 * rest[-1]


def test_shards_of_equal_sizes_over_many_salts(make_docs, monkeypatch):
    monkeypatch.setattr(best_fit_sharding, "SALT_ROWS", 20)
    docs = [(k, f"text {k:06}") for k in range(1200)]
    loads = check_shards(best_fit_sharding.sharded(make_docs(docs, 3)).collect(), docs, 24)
    assert set(loads) == {50 * 19}


def test_shards_of_hard_rows(make_docs, hard_rows):
    rows = best_fit_sharding.sharded(make_docs(hard_rows)).collect()
    check_shards(rows, [r[:2] for r in hard_rows], 24)
    assert best_fit_sharding.sharded(make_docs([])).count() == 0


def test_fixed_capacity_and_written_shards(make_docs, hard_rows, tmp_path, monkeypatch):
    docs = [(k, "x" * (k * 37 % 90)) for k in range(300)]
    out = best_fit_sharding.assign_shards(make_docs(docs), None, 1_000).collect()
    groups = Counter()
    for k, t in docs:
        groups[t] += len(t) + 8
    free, _ = best_fit(list(groups.values()), 1_000)
    loads = Counter()
    for r in out:
        loads[r.shard] += r["size"]
    assert len(loads) == len(free)
    assert sum(v > 1_000 for v in loads.values()) == sum(v > 1_000 for v in groups.values())
    with pytest.raises(ValueError, match="either"):
        best_fit_sharding.assign_shards(make_docs(docs), 3, 1_000)
    monkeypatch.setattr(best_fit_sharding, "FILE_ROWS", 2)
    table = best_fit_sharding.write_shards(make_docs(hard_rows), str(tmp_path / "shards"), 3)
    assert sorted((r.doc_id or -1, r.text or "") for r in table.collect()) == sorted((r[0] or -1, r[1] or "") for r in hard_rows)
    assert {"rank", "lang", "n_chars", "shard", "slot"} <= set(table.columns)


# --- centroid clustering


def brute_clusters(vectors, k=40, rounds=5):
    ids = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    centroids = [v for _, v in ids[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in vectors:
            members[nearest(v)[1]].append(v)
        for n, vs in members.items():
            centroids[n] = tuple(sum(x) // len(vs) for x in zip(*vs, strict=True))
    found = [(i, *nearest(v)[::-1]) for i, v in vectors]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found)


def vectors_frame(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(partitions) if rows else spark.createDataFrame([], "vec_id long, embedding array<double>")
    return df.selectExpr("*", "'x' AS cluster", "'x' AS distance", "'x' AS v", "'x' AS n", "'x' AS s1")


def integer_rows(rows):
    return [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows]


def test_clusters_match_sql(spark):
    against_sql(spark, "op12_hadamard_clustering", ["embeddings"], "vec_id")


def test_clusters_of_hard_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, (rng.normal(size=64) * 0.1 + (k % 5)).tolist()) for k in range(120)]
    good += [(k, good[3][1]) for k in range(200, 230)] + [(7, good[7][1]), (7, good[8][1]), (None, good[9][1]), (-5, [0.0] * 64)]
    bad = [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [None] + [0.5] * 63), (305, [math.nan] * 64), (306, [math.inf] + [0.0] * 63), (307, [2.0**19] + [0.0] * 63)]
    got = hadamard_clustering.cluster(vectors_frame(spark, good + bad)).collect()
    assert Counter(map(tuple, got)) == brute_clusters(integer_rows(good))


def test_few_large_and_no_vectors(spark):
    few = [(1, [1e5] * 64), (2, [-1e5] * 32 + [3.0] * 32), (3, [5e5, -5e5] * 32)]
    assert Counter(map(tuple, hadamard_clustering.cluster(vectors_frame(spark, few)).collect())) == brute_clusters(integer_rows(few))
    assert hadamard_clustering.cluster(vectors_frame(spark, [])).count() == 0
    assert hadamard_clustering.cluster(vectors_frame(spark, [(1, None)])).count() == 0


def test_transform_keeps_distances_and_ties_go_low():
    rng = np.random.default_rng(1)
    x = rng.integers(-999, 999, (50, 64))
    t = hadamard_clustering.hadamard(x)
    assert ((t[:1] - t) ** 2).sum(axis=1).tolist() == (64 * ((x[:1] - x) ** 2).sum(axis=1)).tolist()
    centroids = np.concatenate([x[:6], x[:6]])
    cluster, distance = hadamard_clustering.Search(centroids).nearest(x)
    want = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert cluster.tolist() == want.argmin(axis=1).tolist() and distance.tolist() == want.min(axis=1).tolist()
    assert cluster[:6].tolist() == list(range(6))


# --- importance resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute_resampling(docs, target, percent=5):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features_of(text))
    for text in target:
        t.update(features_of(text))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        mine = features_of(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in mine)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(mine), weight, score, len(words_of(text)) >= 20 and doc_id is not None))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    drawn = [r[:4] for r in order[: percent * len(order) // 100]]
    return Counter(r[:4] for r in out), drawn


def check_resampling(rows, docs, target, percent=5):
    whole, drawn = brute_resampling(docs, target, percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in rows) == whole
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.n_features, r.weight, r.score) for r in ranked] == drawn


def test_resampling_matches_sql(spark):
    against_sql(spark, "op13_importance_resampling", ["documents", "benchmark"], "doc_id")


@pytest.mark.parametrize("many", [0.125, 4.0])
def test_resampling_of_hard_rows(make_docs, hard_rows, monkeypatch, many):
    monkeypatch.setattr(importance_resampling, "SEGMENTS_PER_ROOT", many)
    monkeypatch.setattr(importance_resampling, "RUN_ROWS", 40)
    monkeypatch.setattr(importance_resampling, "SAMPLE_STEP", 4)
    long_words = "w" * 70 + " " + "v" * 64 + " " + "u" * 65 + " " + "x" * 3000 + " a b " + "y" * 64
    rows = hard_rows + [(20, long_words), (21, "ein " + long_words * 3), (22, "x" * 200_000)]
    rows += [(100 + k, f"this text number {k} has some words and so " * 3) for k in range(300)]
    rows += [(500, "one row that is repeated with the same id and twenty words " * 2)] * 40
    target = ["this text has some words", None, "", "der Satz " * 30, "W" * 70 + " " + "v" * 64]
    bench = make_docs([(k, t) for k, t in enumerate(target)])
    for percent in (5, 60):
        got = importance_resampling.resample(make_docs(rows, 7), bench, percent).collect()
        check_resampling(got, [r[:2] for r in rows], target, percent)


def test_resampling_of_nothing(make_docs, hard_rows):
    assert importance_resampling.resample(make_docs([]), make_docs(hard_rows)).count() == 0
    got = importance_resampling.resample(make_docs(hard_rows), make_docs([])).collect()
    check_resampling(got, [r[:2] for r in hard_rows], [])
    drawn = importance_resampling.drawn_documents(make_docs([(k, f"twenty words or more {k} " * 5) for k in range(40)]), make_docs([]))
    assert drawn.count() == 2 and set(drawn.columns) >= {"doc_id", "text", "lang", "rank"}
