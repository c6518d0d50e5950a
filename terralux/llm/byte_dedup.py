"""Removal of repeated byte strings by blockwise suffix sorting over a difference cover.

Every byte covered by a ``WIDTH``-byte string that also starts earlier (smaller doc_id, or earlier in
the same document) is removed; strings are judged on the input, overlaps count, and nothing
matches across documents.

Positions congruent to a difference cover of ``PERIOD`` are sample suffixes: two equal
``WIDTH``-byte strings have, at one common distance below ``PERIOD``, a sample suffix each, whose
next ``KEY`` bytes are equal too. Sample suffixes are dealt to buckets and sorted bucket by bucket,
so memory is bounded by a bucket. A sample whose rank no other shares settles all strings that
lean on it; strings that lean on a shared rank are sorted by their ``WIDTH`` bytes, again
bucket by bucket, and all but the first of equal ones start a removed span. Longer prefixes never decide
anything here, so ties end at ``WIDTH`` bytes.

Of equal texts only the one of the smallest id is sorted; every string of the others starts earlier in it.

What is sorted are 64-bit hashes of the prefixes, in buckets by independent bits. Prefixes within a
task travel packed. Of each different prefix a block of texts sends one position to the prefix's bucket; what
the block itself proves of the others (repeated samples, later copies) goes on to the texts' part, without its
hash. A hot string thus meets in one bucket once per block, however many positions it has.

Null text is empty. Equal rows each get the result; rows of one doc_id with different texts are documents of their own. Rows with a
null id neither lose nor repeat anything. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralux.llm.common import (
    Rolling,
    bucket_count,
    bucket_of,
    byte_view,
    chunked_texts,
    cut,
    dealt,
    from_varint,
    group_ranks,
    small_batches,
    text_bytes,
    to_varint,
)

WIDTH = 100
#: A difference cover of Z_31: every residue but 0 is a difference of two of these in exactly one way. A
#: longer period samples fewer suffixes, but their shorter keys let more strings through that do not repeat.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of a string's hash that are sent; its bucket tells further bits.
HASH_BYTES = 7
KEY = WIDTH - PERIOD
#: Bytes of text whose keys are sent together.
BLOCK_BYTES = 16_000_000

DIGEST = "doc_id long, n_bytes long, class long"
PACKED = "bucket long, ids binary, counts binary, places binary, keys binary"
FOUND = "part long, ids binary, counts binary, places binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def _packed_ids(ids: np.ndarray, places: np.ndarray) -> list[bytes]:
    """Runs of equal ids, their sizes, and the places as differences within a run (ascending)."""
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    first = np.flatnonzero(new)
    step = np.diff(places, prepend=0)
    step[first] = places[first]
    return [ids[first].tobytes(), to_varint(np.diff(np.append(first, len(ids)))), to_varint(step)]


def _unpacked_ids(row: dict) -> tuple[np.ndarray, np.ndarray]:
    counts = from_varint(row["counts"])
    step = from_varint(row["places"])
    sums = np.cumsum(step)
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, sums[first - 1], 0)
    return np.repeat(np.frombuffer(row["ids"], dtype=np.int64), counts), sums - np.repeat(before, counts)


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def text_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each text as a whole."""
    raw = data.tobytes()
    sums = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
    return np.frombuffer(sums, dtype=np.int64)


def digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunked_texts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(text_classes(data, offsets))], ["doc_id", "n_bytes", "class"])

    return docs.mapInArrow(run, DIGEST)


def _proven(ids: np.ndarray, places: np.ndarray, n: int) -> list[tuple]:
    """Positions that need no comparison any more: rows without keys, by the part of their texts."""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    return [(p, *_packed_ids(ids[i], places[i]), None) for p, i in dealt(ids.view(np.uint64), n)]


def _passed_on(rows: list[dict]) -> tuple[list[dict], list[pa.RecordBatch]]:
    """Rows with keys, and what is proven already."""
    done = [(r["bucket"], r["ids"], r["counts"], r["places"]) for r in rows if r["keys"] is None]
    return [r for r in rows if r["keys"] is not None], [_batch(FOUND, done)] if done else []


def _firsts(hashes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which positions are the first of their hash, and of the repeated hashes each position and its first.

    A position that is listed twice counts once.
    """
    order = np.argsort(hashes, kind="stable")
    tie = np.zeros(len(hashes), dtype=bool)
    tie[1:] = hashes[order][1:] == hashes[order][:-1]
    tie[:-1] |= tie[1:]
    several = order[tie]
    several = several[np.lexsort((places[several], ids[several], hashes[several]))]
    h, i, p = hashes[several], ids[several], places[several]
    head = np.ones(len(several), dtype=bool)
    head[1:] = h[1:] != h[:-1]
    new = head.copy()
    new[1:] |= (i[1:] != i[:-1]) | (p[1:] != p[:-1])
    first = several[np.maximum.accumulate(np.where(head, np.arange(len(several)), 0))] if len(several) else several
    sent = np.ones(len(hashes), dtype=bool)
    sent[several[~head]] = False
    return sent, several[new], first[new]


def _sample_keys(n_buckets: int):
    """Keys of the sample suffixes of each block of different texts, dealt to buckets; a text goes by its class."""
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def keys(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.diff(offsets)
        usable = np.where(sizes >= WIDTH, sizes - KEY + 1, 0)
        place = group_ranks(usable)
        sampled = in_cover[place % PERIOD]
        place = place[sampled]
        doc = np.repeat(np.arange(len(sizes)), usable)[sampled]
        at = offsets[doc] + place
        return ids[doc], place, Rolling(data).of(at, at + KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ids, places, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            sent, several, first = _firsts(hashes, ids, places)
            # All positions of a prefix that stands at two or more are shared, its first too.
            repeated = several != first
            shared = np.concatenate([several[repeated], np.unique(first[repeated])])
            proven = _proven(ids[shared], places[shared], n_buckets)
            ids, places, hashes = ids[sent], places[sent], hashes[sent]
            rows = proven + [(b, *_packed_ids(ids[i], places[i]), (hashes[i] >> np.uint64(32)).astype(np.uint32).tobytes()) for b, i in dealt(hashes, n_buckets)]
            return _batch(PACKED, rows)

        for _, data, offsets in chunked_texts(batches):
            held.append(keys(data, offsets, text_classes(data, offsets)))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _by_part(ids: np.ndarray, places: np.ndarray, n_parts: int) -> pa.Table:
    """Positions, back to the parts of their documents, each document's in order."""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    return pa.Table.from_batches([_batch(FOUND, [(p, *_packed_ids(ids[i], places[i])) for p, i in dealt(ids.view(np.uint64), n_parts)])])


def _shared_samples(n_parts: int):
    """Of a bucket's sample suffixes: those whose rank a suffix of another text or place shares."""

    def run(table: pa.Table) -> pa.Table:
        rows, proven = _passed_on(table.to_pylist())
        if not rows:
            return pa.Table.from_batches(proven)
        keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint32) for r in rows])
        packed = np.sort((keys.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64))
        sorted_keys = packed >> np.uint64(32)
        tie = np.zeros(len(keys), dtype=bool)
        tie[1:] = sorted_keys[1:] == sorted_keys[:-1]
        tie[:-1] |= tie[1:]
        index = (packed[tie] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids, places = (np.concatenate(x)[index] for x in zip(*map(_unpacked_ids, rows), strict=True))
        # Equal texts have sent the same suffixes.
        keys = keys[index]
        order = np.lexsort((places, ids, keys))
        keys, ids, places = keys[order], ids[order], places[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])
        keys, ids, places = keys[new], ids[new], places[new]
        tie = np.zeros(len(keys), dtype=bool)
        tie[1:] = keys[1:] == keys[:-1]
        tie[:-1] |= tie[1:]
        return pa.Table.from_batches([*proven, *_by_part(ids[tie], places[tie], n_parts).to_batches()])

    return run


def _positions(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, place) of a part, ordered."""
    rows = right.to_pylist()
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ids, places = (np.concatenate(x) for x in zip(*map(_unpacked_ids, rows), strict=True))
    order = np.lexsort((places, ids))
    return ids[order], places[order]


def _first_ids(n_parts: int):
    """Positions by class become positions in the first document of the class."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        classes, places = _positions(left)
        order = np.argsort(right.column("class").to_numpy())
        known, first = right.column("class").to_numpy()[order], right.column("first_id").to_numpy()[order]
        return _by_part(first[np.searchsorted(known, classes)] if len(classes) else classes, places, n_parts)

    return run


def _whole_texts(n_parts: int):
    """Later copies of a text, as starts that cover it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            n = (sizes - 1) // WIDTH + 1
            starts = np.minimum(group_ranks(n) * WIDTH, np.repeat(sizes - WIDTH, n))
            yield from _by_part(np.repeat(batch.column(0).to_numpy(), n), starts, n_parts).to_batches()

    return run


def _of_documents(ids: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of each document's entries in the ordered ``listed``."""
    return np.searchsorted(listed, ids, side="left"), np.searchsorted(listed, ids, side="right")


def _windows(n_buckets: int):
    """Strings that lean on a shared sample: their hashes, dealt to buckets."""

    def sent(hashes: np.ndarray) -> bytes:
        return hashes.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        listed, samples = _positions(right)
        out = []
        if left.num_rows and len(listed):
            data, offsets = byte_view(left.column("text"))
            ids = left.column("doc_id").to_numpy()
            low, high = _of_documents(ids, listed)
            found = []
            rolling_from, rolling = -1, None
            for k in np.flatnonzero(high > low):
                last = int(offsets[k + 1] - offsets[k]) - WIDTH
                # Strings that start up to PERIOD - 1 bytes before a shared sample.
                sample = samples[low[k] : high[k]]
                mark = np.zeros(last + 2, dtype=np.int32)
                np.add.at(mark, np.minimum(np.maximum(sample - PERIOD + 1, 0), last + 1), 1)
                np.add.at(mark, np.minimum(sample + 1, last + 1), -1)
                starts = np.flatnonzero(np.cumsum(mark[:-1]))
                if rolling is None or rolling_from != k:
                    rolling = Rolling(data[offsets[k] : offsets[k + 1]])
                found.append((np.full(len(starts), ids[k]), starts, rolling.of(starts, starts + WIDTH)))
            ids, starts, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
            first_ones, several, first = _firsts(hashes, ids, starts)
            later = several[several != first]
            proven = _proven(ids[later], starts[later], n_buckets)
            ids, starts, hashes = ids[first_ones], starts[first_ones], hashes[first_ones]
            out = proven + [(b, *_packed_ids(ids[i], starts[i]), sent(hashes[i])) for b, i in dealt(hashes, n_buckets)]
        return pa.Table.from_batches([_batch(PACKED, out)])

    return run


def _later_copies(n_parts: int):
    """Of a bucket's strings: starts of all but the first of equal ones."""

    def run(table: pa.Table) -> pa.Table:
        rows, proven = _passed_on(table.to_pylist())
        if not rows:
            return pa.Table.from_batches(proven)
        short = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint8) for r in rows]).reshape(-1, HASH_BYTES)
        keys = np.zeros((len(short), 8), dtype=np.uint8)
        keys[:, :HASH_BYTES] = short
        keys = keys.view(np.uint64).reshape(-1)
        ids, starts = (np.concatenate(x) for x in zip(*map(_unpacked_ids, rows), strict=True))
        order = np.lexsort((starts, ids, keys))
        keys, ids, starts = keys[order], ids[order], starts[order]
        head = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
        later = (ids != ids[first]) | (starts != starts[first])
        return pa.Table.from_batches([*proven, *_by_part(ids[later], starts[later], n_parts).to_batches()])

    return run


def _remains(left: pa.Table, right: pa.Table) -> pa.Table:
    """Spans that go, and the digest of what stays."""
    listed, starts = _positions(right)
    data, offsets = byte_view(left.column("text"))
    ids = left.column("doc_id").to_numpy(zero_copy_only=False) if not left.column("doc_id").null_count else None
    n = left.num_rows
    low, high = _of_documents(ids, listed) if ids is not None else (np.zeros(n, dtype=int), np.zeros(n, dtype=int))
    out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends")}
    for k in range(n):
        text = data[offsets[k] : offsets[k + 1]]
        mine = starts[low[k] : high[k]]
        keep = hashlib.sha256()
        at, begins, ends = 0, [], []
        if len(mine):
            gap = np.flatnonzero(np.diff(mine) > WIDTH)
            begins = mine[np.concatenate([[0], gap + 1])].tolist()
            ends = (mine[np.concatenate([gap, [len(mine) - 1]])] + WIDTH).tolist()
        for a, b in zip(begins, ends, strict=True):
            keep.update(text[at:a])
            at = b
        keep.update(text[at:])
        for name, value in (
            ("n_bytes", len(text)),
            ("n_removed", sum(ends) - sum(begins)),
            ("n_spans", len(begins)),
            ("kept_sha256", keep.hexdigest()),
            ("starts", begins),
            ("ends", ends),
        ):
            out[name].append(value)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([left.column("doc_id"), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], names=["doc_id", *out])


def _part_of(n: int):
    """Adds the part of the first column's ids, as ``dealt`` deals them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket_of(ids.view(np.uint64), n))], [*batch.schema.names, "part"])

    return run


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in chunked_texts(batches):
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text_classes(data, offsets))], [*part.schema.names, "class"])


def _row_keys(digest: DataFrame) -> DataFrame | None:
    """(doc_id, class, key) if an id has different texts: numbers in the order of ids, an id's texts in the order of their hashes."""
    texts = digest.select("doc_id", "class").distinct()
    if texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    return cut(texts.repartitionByRange("doc_id", "class").sortWithinPartitions("doc_id", "class").withColumn("key", F.monotonically_increasing_id()), "row-keys")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed spans and the digest of the remaining bytes.

    Rows of one id with different texts are documents of their own, in the order of their texts' hashes.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    digest = cut(digests(docs.where("doc_id is not null")), "digests")
    keys = _row_keys(digest)
    if keys is None:
        return _spans_of(docs, digest)
    named = docs.mapInArrow(_with_class, "doc_id long, text string, class long")
    numbered = cut(named.join(keys, ["doc_id", "class"], "left").select(F.col("key").alias("doc_id"), "text"), "numbered-documents")
    found = _spans_of(numbered, digest.join(keys, ["doc_id", "class"]).select(F.col("key").alias("doc_id"), "n_bytes", "class"))
    back = keys.select("key", F.col("doc_id").alias("_id"))
    return found.join(back, found["doc_id"] == back["key"], "left").withColumn("doc_id", F.col("_id")).drop("key", "_id")


def _spans_of(docs: DataFrame, digest: DataFrame) -> DataFrame:
    known = docs.where("doc_id is not null")
    n = bucket_count(text_bytes(docs))
    dealt_docs = docs.mapInArrow(_part_of(n), "doc_id long, text string, part long")
    firsts = digest.groupBy("class").agg(F.min("doc_id").alias("first_id"))
    shared = known.mapInArrow(_sample_keys(n), PACKED).groupBy("bucket").applyInArrow(_shared_samples(n), FOUND)
    owners = firsts.mapInArrow(_part_of(n), "class long, first_id long, part long")
    samples = cut(shared.groupBy("part").cogroup(owners.groupBy("part")).applyInArrow(_first_ids(n), FOUND), "shared-samples")
    with_id = known.mapInArrow(_part_of(n), "doc_id long, text string, part long")
    windows = with_id.groupBy("part").cogroup(samples.groupBy("part")).applyInArrow(_windows(n), PACKED)
    copies = digest.join(firsts, "class").where((F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= WIDTH)).select("doc_id", "n_bytes")
    later = windows.groupBy("bucket").applyInArrow(_later_copies(n), FOUND).union(copies.mapInArrow(_whole_texts(n), FOUND))
    later = cut(later, "later-copies")
    # Rows without an id form a part of their own size: salted, they have no positions.
    salted = dealt_docs.withColumn("part", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(n))).otherwise(F.col("part")))
    return salted.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(_remains, RESULT)
