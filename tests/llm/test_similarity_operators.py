"""Jaccard join and nearest neighbours against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from llm_cases import SF_DIR, hard_rows, make_docs  # noqa: F401

from terralux.llm import ann_forest, jaccard_join, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_force_groups(docs):
    sets = {k: shingles(t) for k, t in docs if k is not None}
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    by_shingle = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by_shingle[x].append(k)
    tried = set()
    for ids in by_shingle.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        label[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def compare(got, docs):
    want = brute_force_groups(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(docs)
    return want


def test_jaccard_of_corpus(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    got = queries.QUERIES["op10_jaccard_join"](spark, SF_DIR).collect()
    want = compare(got, list(zip(docs.doc_id, docs.text, strict=True)))
    assert any(k != c for k, (_, c) in want.items())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize(("seed", "small_group", "buckets"), [(0, 12, 1), (1, 2, 5), (2, 3, 4), (3, 2, 7)])
def test_jaccard_against_all_pairs(make_docs, monkeypatch, seed, small_group, buckets):  # noqa: F811
    """Families with links near the threshold, all sizes, a passage in many documents; small and large groups."""
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", small_group)
    monkeypatch.setattr(jaccard_join, "bucket_count", lambda *_: buckets)
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(30)]
    docs = []
    for family in range(14):
        size = rng.choice([1, 3, 5, 6, 8, 9, 12, 20, 60, 150])
        base = [f"w{family}x{k}" for k in range(size)]
        for _ in range(rng.randint(1, 9)):
            words = edited(rng, base, rng.randint(0, max(1, size // 30)))
            if rng.random() < 0.3:
                words = words[: max(1, int(size * rng.uniform(0.75, 1)))]
            if rng.random() < 0.4:
                words += common
            docs.append((len(docs) * 3 - 40, " ".join(words)))
    compare(jaccard_join.near_duplicates(make_docs(docs, 3)).collect(), docs)


def test_jaccard_of_hard_rows(make_docs, hard_rows):  # noqa: F811
    docs = [*hard_rows, (50, "a a a a a a a a a"), (51, "A a\ta a a a"), (52, "a b c"), (53, "a  B c")]
    got = jaccard_join.near_duplicates(make_docs(docs)).collect()
    compare(got, docs)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    frame = make_docs(docs)
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns
    want = brute_force_groups(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(k for k, _ in docs if k is not None and want[k][1] == k)
    assert jaccard_join.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize(("seed", "sent_bytes"), [(0, None), (1, None), (2, None), (3, None), (0, 1), (1, 1), (2, 2)])
def test_similar_sets_share_a_kept_signature(monkeypatch, seed, sent_bytes):
    """The guarantee itself: of every similar pair, the rarest common signatures survive on both sides.

    With one byte of a signature many of a set cannot be told apart, and the guarantee must hold all the same.
    """
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(4, 120)), dtype=np.uint64)
        for _ in range(3):
            keep = rng.random(len(base)) < rng.uniform(0.85, 1)
            more = rng.integers(0, 2**63, int(len(base) * rng.uniform(0, 0.12)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[keep], more])))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    owner, drops, signs = jaccard_join.signatures(np.concatenate(sets), first)
    if sent_bytes:
        monkeypatch.setattr(jaccard_join, "SENT_BYTES", sent_bytes)
        before = len(signs)
        owner, drops, signs = jaccard_join.one_of_each(owner, drops, signs, 3)
        assert len(signs) < before or sent_bytes > 1
        signs = jaccard_join.sent_form(signs, 3)
    # How many sets have a signature, as the bucket counts them.
    uses = dict(zip(*np.unique(np.array(sorted(set(zip(signs.tolist(), owner.tolist(), strict=True))), dtype=np.uint64)[:, 0], return_counts=True), strict=True))
    kept = defaultdict(set)
    for unit in {(int(o), int(d)) for o, d in zip(owner, drops, strict=True)}:
        mine = sorted(signs[(owner == unit[0]) & (drops == unit[1])].tolist(), key=lambda x: (-uses[x], x))
        kept[unit[0]].update(mine[unit[1] :])
    n = 0
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and both < max(len(sets[i]), len(sets[j])):
                n += 1
                assert kept[i] & kept[j], (i, j, len(sets[i]), len(sets[j]))
    assert n > 20


@pytest.mark.parametrize("hub", [-(2**62), 2**62])
def test_sets_of_a_hubs_partners_are_spread(spark, monkeypatch, hub):
    """A large group whose members all meet one class: no part of the tests gets a large share of their sets."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 90, dtype=np.uint64)
    rows = [(hub, 90, np.sort(common).tobytes())]
    for k in range(1, 401):
        own = rng.integers(0, 2**63, 15, dtype=np.uint64)
        rows.append((k * 7919, 105, np.sort(np.concatenate([common, own])).tobytes()))
    sets = spark.createDataFrame([(c, n, bytearray(h)) for c, n, h in rows], "class long, size long, hashes binary")
    members = sets.selectExpr("1L AS signature", "class")
    received = []
    real = jaccard_join.linked_pairs

    def watched(pairs, sets, n, percent):
        named = jaccard_join.placed_pairs(pairs, n).selectExpr("part", "explode(array(a, b)) AS class").distinct()
        received.append([r["count"] for r in named.groupBy("part").count().collect()])
        return real(pairs, sets, n, percent)

    monkeypatch.setattr(jaccard_join, "linked_pairs", watched)
    none = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "class long, component long")
    found = jaccard_join.connect_large_groups(members, none, labels, sets, 40, 80).collect()
    assert len(found) == 400 and len({r.component for r in found}) == 1
    assert sum(received[0]) == 440 and max(received[0]) <= 40


def test_texts_far_from_their_hub_are_not_all_compared(spark, monkeypatch):
    """Of a large group that stays in pieces, fewer pairs are tested, and no link is missed."""
    rng = np.random.default_rng(1)
    common = np.sort(rng.integers(0, 2**63, 150, dtype=np.uint64))

    def edit(s, lacks, adds):
        return np.unique(np.concatenate([rng.permutation(s)[lacks:], rng.integers(0, 2**63, adds, dtype=np.uint64)]))

    sets = [common]
    for _ in range(150):
        n = int(rng.integers(4, 26))
        sets.append(edit(common, *[(n, n), (n + 8, 0), (0, n)][int(rng.choice(3, p=[0.8, 0.1, 0.1]))]))
    sets += [edit(sets[int(k)], 5, 5) for k in rng.integers(1, 150, 40)]
    order = rng.permutation(len(sets))
    sets = {int(k) * 7919 - 500_000: sets[i] for i, k in enumerate(order)}
    component = {c: c for c in sets}
    for a, x in sets.items():
        for b, y in sets.items():
            both = len(np.intersect1d(x, y)) if a < b else 0
            if a < b and 100 * both >= 80 * (len(x) + len(y) - both) and component[a] != component[b]:
                old, new = component[a], component[b]
                component = {c: new if k == old else k for c, k in component.items()}
    tested, real = [], jaccard_join.linked_pairs

    def watched(pairs, sets, n, percent):
        tested.append(pairs.count())
        return real(pairs, sets, n, percent)

    monkeypatch.setattr(jaccard_join, "linked_pairs", watched)
    frame = spark.createDataFrame([(c, len(h), bytearray(h.tobytes())) for c, h in sets.items()], "class long, size long, hashes binary")
    members = frame.selectExpr("1L AS signature", "class").union(frame.where("class % 2 = 0").selectExpr("2L AS signature", "class"))
    none, labels = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "class long, component long")
    found = {r["class"]: r["component"] for r in jaccard_join.connect_large_groups(members, none, labels, frame, 5, 80).collect()}
    pieces = defaultdict(set)
    for c, k in component.items():
        pieces[k].add(c)
    got = defaultdict(set)
    for c in sets:
        got[found.get(c, c)].add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, pieces.values())) and len(pieces) > 20
    assert sum(tested) < len(sets) ** 2 / 4


def test_near_copies_are_not_held_against_hubs_by_every_signature(spark, monkeypatch):
    """Classes of a large group that share many signatures: few rows for each in the rounds, and no link is missed."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = {}
    for k in range(120):
        n = int(rng.integers(4, 20))
        edited_set = np.concatenate([rng.permutation(common)[n:], rng.integers(0, 2**63, n, dtype=np.uint64)])
        sets[k * 7919 - 400_000] = np.unique(edited_set)
    component = {c: c for c in sets}
    for a, x in sets.items():
        for b, y in sets.items():
            both = len(np.intersect1d(x, y)) if a < b else 0
            if a < b and 100 * both >= 80 * (len(x) + len(y) - both) and component[a] != component[b]:
                old, new = component[a], component[b]
                component = {c: new if k == old else k for c, k in component.items()}
    rows = [(s, c) for s in range(24) for c in sets if s == 0 or rng.random() < 0.9]
    made, real = [], jaccard_join.cut

    def watched(df, label):
        table = real(df, label)
        if "lacks0" in table.columns or "signature" in table.columns:
            made.append(table.count())
        return table

    monkeypatch.setattr(jaccard_join, "cut", watched)
    members = spark.createDataFrame(rows, "signature long, class long")
    frame = spark.createDataFrame([(c, len(h), bytearray(h.tobytes())) for c, h in sets.items()], "class long, size long, hashes binary")
    none, labels = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "class long, component long")
    found = {r["class"]: r["component"] for r in jaccard_join.connect_large_groups(members, none, labels, frame, 5, 80).collect()}
    pieces, got = defaultdict(set), defaultdict(set)
    for c, k in component.items():
        pieces[k].add(c)
        got[found.get(c, c)].add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, pieces.values())) and len(pieces) > 5
    assert sum(made) < 5 * len(rows)


def test_parts_of_the_tests_follow_the_bytes_of_sets(spark, monkeypatch):
    """Partners of one class are split where they are many bytes; parts grow in number with what pairs name."""
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 100_000)
    pairs = spark.range(600).selectExpr("id AS a", "1000L AS b", "300L AS size").withColumn("deal", jaccard_join.dealt_by("b", "a", "size"))
    held = [r["count"] for r in jaccard_join.placed_pairs(pairs, 2).groupBy("part").count().collect()]
    assert max(held) * 8 * 300 * 1.25 < 150_000


# --- nearest neighbours


def brute_force_nearest(rows, k=5):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append((i, np.array(v, dtype=np.float64)))
    out = {}
    for i, q in ok:
        if i % 50 == 0:
            scored = sorted((-float(q @ v / (np.sqrt(q @ q) * np.sqrt(v @ v))), j) for j, v in ok if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_nearest_of_corpus(spark):
    rows = pq.read_table(f"{SF_DIR}/embeddings.parquet").to_pydict()
    want = brute_force_nearest(list(zip(rows["vec_id"], rows["embedding"], strict=True)))
    got = queries.QUERIES["op5_ann_forest"](spark, SF_DIR).collect()
    found = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(q, j) in found for q, x in want.items() for j, _ in x]
    assert np.mean(hits) >= 0.9
    for q, x in want.items():
        for j, s in x:
            if (q, j) in found:
                assert abs(found[q, j] - s) < 1e-12


@pytest.mark.parametrize("n", [6_000, 25_650])
def test_recall_among_vectors_without_structure(spark, n):
    """Clusters that are isotropic inside; of the larger table a search opens less than a fifth."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 64))
    x = 0.6 * centres[rng.integers(0, 10, n)] + rng.normal(size=(n, 64))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}))
    got = ann_forest.nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit[::50] @ unit.T
    close[np.arange(-(-n // 50)), np.arange(0, n, 50)] = -9
    want = {(50 * q, int(j)) for q, row in enumerate(np.argsort(-close, axis=1)[:, :5]) for j in row}
    assert len(got) == -(-n // 50) * 5 and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)


def test_nearest_hard_rows(spark):
    rows = [(k, [float(np.cos(k)), float(np.sin(k)), 1.0]) for k in range(1, 60)]
    rows += [(k, [1.0, 2.0, 3.0]) for k in range(100, 160)]
    rows += [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (350, [float("nan"), 1.0, 1.0]), (400, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (450, [1e300, 2e300, 3e300])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, leaf int, score string")
    got = ann_forest.nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    by_query = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_query[r.query_id].append(r.vec_id)
    assert set(by_query) == {50, 100, 150, 450}
    assert by_query[100] == [101, 102, 103, 104, 105] and by_query[150] == [100, 101, 102, 103, 104]
    assert [r["rank"] for r in got if r.query_id == 50].sort() is None
    assert by_query[50] == [j for j, _ in brute_force_nearest([r for r in rows if r[0] != 450])[50]]
    assert ann_forest.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_queries_of_another_dimension_take_no_part(spark):
    rows = [(k, [float(np.cos(k)), float(np.sin(k)), 1.0]) for k in range(1, 40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    others = spark.createDataFrame([(50, [1.0, 2.0]), (51, [3.0, 1.0]), (52, [1.0, 2.0, 3.0]), (52, [3.0, 2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.query_id for r in ann_forest.nearest(frame, others).collect()} == {52}
    assert ann_forest.nearest(frame, others.where("vec_id < 52")).count() == 0


def test_forest_covers_every_leaf():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann_forest.Forest(x, 3000, 4, 50)
    leaves = forest.index(x)
    assert sorted(forest.search(x[0], np.inf)) == list(range(int(forest.base[-1])))
    # Median splits in single precision: a row on a threshold may fall either way.
    for t, tree in enumerate(forest.trees):
        assert np.abs(np.bincount(leaves[:, t] - forest.base[t], minlength=len(tree.sizes)) - tree.sizes).max() <= 5
    assert set(leaves[5]) <= set(forest.search(x[5], 3000))
