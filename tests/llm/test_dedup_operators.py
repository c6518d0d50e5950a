"""Byte and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from llm_cases import SF_DIR, hard_rows, make_docs  # noqa: F401

from terralux.llm import byte_dedup, line_dedup, queries

# --- bytes


def brute_force_bytes(docs, width=100):
    """Every window in order of (doc_id, start): later equal ones are removed."""
    seen, out = set(), {}
    for doc_id, text in sorted(((k, (t or "").encode()) for k, t in docs if k is not None)):
        if doc_id in out:
            continue
        gone = np.zeros(len(text) + 1, dtype=int)
        for i in range(len(text) - width + 1):
            w = text[i : i + width]
            if w in seen:
                gone[i] += 1
                gone[min(i + width, len(text))] -= 1
            else:
                seen.add(w)
        mask = np.cumsum(gone)[:-1] > 0
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        kept = bytes(b for b, m in zip(text, mask, strict=True) if not m)
        out[doc_id] = (len(text), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_cover_has_every_difference():
    assert {(a - b) % byte_dedup.PERIOD for a in byte_dedup.COVER for b in byte_dedup.COVER} == set(range(byte_dedup.PERIOD))


def compare_bytes(got, docs):
    want = brute_force_bytes(docs)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    return want


def test_byte_dedup_of_corpus(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    got = queries.QUERIES["op7_suffix_array_dedup"](spark, SF_DIR).collect()
    assert len(got) == len(docs)
    want = compare_bytes(got, list(zip(docs.doc_id, docs.text, strict=True)))
    assert any(w[1] for w in want.values())


def test_byte_dedup_of_hard_rows(make_docs, hard_rows):  # noqa: F811
    rng = random.Random(1)
    pool = ["".join(rng.choices("abcdé", k=rng.randint(90, 260))) for _ in range(6)]
    docs = [(k, "".join([*rng.choices("xyz", k=rng.randint(0, 40)), rng.choice(pool)[rng.randint(0, 20) :], rng.choice(pool), *rng.choices("xyz", k=5)])) for k in range(100, 140)]
    docs += [(200, "z" * 99), (201, "z" * 99), (202, "q" * 300), (203, "q" * 100), *[r for r in hard_rows if r[0] != 4]]
    got = byte_dedup.repeated_spans(make_docs(docs)).collect()
    assert len(got) == len(docs)
    compare_bytes(got, docs)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert byte_dedup.repeated_spans(make_docs([])).count() == 0


def test_byte_dedup_of_rows_with_one_id(make_docs):  # noqa: F811
    """Different texts under one id are documents of their own, in the order of their hashes."""
    rng = random.Random(8)
    long, other = ("".join(rng.choices("abcdefgh", k=300)) for _ in range(2))
    docs = [(5, long), (5, "short"), (5, other + long[:150]), (9, long), (9, long), (7, None), (7, other), (None, long)]
    known = [(k, t or "") for k, t in docs if k is not None]
    data, offsets = byte_dedup.byte_view(pa.array([t for _, t in known]))
    order = sorted(set(zip([k for k, _ in known], byte_dedup.text_classes(data, offsets).tolist(), [t for _, t in known])))
    want = brute_force_bytes([(n, t) for n, (_, _, t) in enumerate(order)])
    by_row = {(k, len(t.encode())): want[n] for n, (k, _, t) in enumerate(order)}
    got = byte_dedup.repeated_spans(make_docs(docs)).collect()
    assert len(got) == len(docs) and [r.n_removed for r in got if r.doc_id is None] == [0]
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == by_row[r.doc_id, r.n_bytes]
    assert sum(r.n_removed > 0 for r in got) >= 3


@pytest.mark.parametrize("seed", range(3))
def test_byte_dedup_over_many_parts(make_docs, monkeypatch, seed):  # noqa: F811
    monkeypatch.setattr(byte_dedup, "bucket_count", lambda _: 5)
    rng = random.Random(seed)
    base = "".join(rng.choices("abcdefgh \n", k=3000))
    docs = []
    for k in range(30):
        a = rng.randint(0, 2500)
        piece = list(base[a : a + rng.randint(50, 500)])
        for _ in range(rng.randint(0, 3)):
            piece[rng.randrange(len(piece))] = "#"
        docs.append((rng.randint(-50, 1000) * 31 + k, "".join(piece) + "".join(rng.choices("mnop", k=30))))
    compare_bytes(byte_dedup.repeated_spans(make_docs(docs, 4)).collect(), docs)


def test_hot_strings_meet_once_per_block(make_docs, monkeypatch):  # noqa: F811
    """Rules of dashes and periodic texts: of each string a block sends one position to be compared."""
    monkeypatch.setattr(byte_dedup, "bucket_count", lambda _: 3)
    docs = [(k, f"start {k} " + "-" * 700 + f" {k} " + "ab" * 300 + f" end {k}") for k in range(60)]
    met = []
    for name, size in (("_shared_samples", 4), ("_later_copies", byte_dedup.HASH_BYTES)):
        frame = make_docs(docs, 2).select("doc_id", "text").toPandas()
        table = pa.RecordBatch.from_pandas(frame, preserve_index=False)
        if name == "_shared_samples":
            rows = [r for b in byte_dedup._sample_keys(3)(iter([table])) for r in b.to_pylist()]
        else:
            ids = np.repeat(np.arange(60), 20)
            places = byte_dedup._by_part(ids, np.tile(np.arange(20) * 30, 60), 1)
            rows = byte_dedup._windows(3)(pa.Table.from_batches([table]), places).to_pylist()
        keys = [r["keys"] for r in rows if r["keys"] is not None]
        met.append((sum(map(len, keys)) // size, len({(r["bucket"], r["keys"][i : i + size]) for r in rows if r["keys"] for i in range(0, len(r["keys"]), size)})))
    assert all(n == different for n, different in met), met
    compare_bytes(byte_dedup.repeated_spans(make_docs(docs, 4)).collect(), docs)


# --- lines


def brute_force_lines(docs, min_words):
    """Maximal runs by direct comparison of all pairs of places."""
    listed = {}
    for doc_id, text in docs:
        if doc_id is not None and doc_id not in listed:
            listed[doc_id] = [x for x in (text or "").split("\n") if x.encode().strip()]
    places = [(d, i) for d in sorted(listed) for i in range(len(listed[d]))]
    by_line = {}
    for d, i in places:
        by_line.setdefault(listed[d][i], []).append((d, i))
    gone = {d: set() for d in listed}
    for d, i in places:
        for e, j in by_line[listed[d][i]]:
            if (e, j) >= (d, i):
                break
            n = 0
            while i + n < len(listed[d]) and j + n < len(listed[e]) and listed[d][i + n] == listed[e][j + n]:
                n += 1
            if sum(len(x.encode().split()) for x in listed[d][i : i + n]) >= min_words:
                gone[d].update(range(i, i + n))
    out = {}
    for doc_id, text in docs:
        if text is None or doc_id is None:
            out[doc_id] = text
            continue
        kept, number = [], 0
        for line in text.split("\n"):
            blank = not line.encode().strip()
            if blank or number not in gone[doc_id]:
                kept.append(line)
            number += not blank
        out[doc_id] = "\n".join(kept) if any(x.encode().strip() for x in kept) or not gone[doc_id] else ""
    return out


def test_line_dedup_of_corpus(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    want = brute_force_lines(list(zip(docs.doc_id, docs.text, strict=True)), line_dedup.MIN_WORDS)
    got = queries.QUERIES["op6_line_dedup"](spark, SF_DIR).collect()
    assert {r.doc_id: r.text_sha256 for r in got} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}
    assert any(want[k] != t for k, t in zip(docs.doc_id, docs.text, strict=True))


@pytest.mark.parametrize(("seed", "min_words"), [(0, 5), (1, 12), (2, 1), (3, 30)])
def test_line_dedup_against_pairs(make_docs, seed, min_words):  # noqa: F811
    rng = random.Random(seed)
    lines = [" ".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(9)] + ["", " \t"]
    base = [rng.choice(lines) for _ in range(40)]
    docs = []
    for k in range(30):
        a = rng.randrange(30)
        part = [*rng.choices(lines, k=rng.randint(0, 4)), *base[a : a + rng.randint(0, 25)], *rng.choices(lines, k=rng.randint(0, 3))]
        docs.append((k * 7 - 20, "\n".join(part)))
    got = line_dedup.delete_repeated_lines(make_docs(docs, 3), min_words)
    assert {r.doc_id: r.text for r in got.collect()} == brute_force_lines(docs, min_words)


def test_line_dedup_of_hard_rows(make_docs, hard_rows):  # noqa: F811
    twice = "\n".join(f"line {k} of the passage" for k in range(20))
    docs = [*hard_rows, (300, twice), (301, f"own line\n\n{twice}\nlast line"), (302, twice)]
    frame = make_docs(docs)
    got = line_dedup.delete_repeated_lines(frame)
    assert got.columns == frame.columns
    rows = got.collect()
    assert len(rows) == len(docs)
    want = brute_force_lines(docs, line_dedup.MIN_WORDS)
    assert all(r.text == want[r.doc_id] and (r.n_chars == (len(r.text) if r.text is not None else None)) for r in rows)
    assert want[302] == "" and want[301] == "own line\n\nlast line"
    assert line_dedup.delete_repeated_lines(make_docs([])).count() == 0
