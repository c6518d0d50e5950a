"""Target-distribution importance resampling with exact ranks by regular sampling.

Features are the runs of 1 to ``RUN`` consecutive words, hashed to ``BUCKETS`` buckets by the crc32 of their
bytes. Checksums are linear, so that of a run follows from those of its words and their lengths by
table lookups, for all words of many documents at once. Counts are one array per task, and the gains
of all buckets are one array of ``BUCKETS`` integers, with which documents are scored.

The drawn documents are the highest scores in their exact order, found by parallel sorting by regular
sampling: each task sorts its rows in runs and hands on regular samples of them (``SAMPLES`` a task), which
give splitters of segments of nearly equal size; counts of the segments, summed in order, give the rank before
each segment and tell which of them are drawn from at all; only their rows are exchanged, each
segment is sorted where it arrives, and ranks are exact. The number of segments grows with the square
root of the rows, and so does what the driver holds. The key is (score, id, row), so that
equal scores and repeated ids do not pile up in a segment.

A null text has no words: no features, weight 0. Documents with fewer than ``LEAST_WORDS`` words are scored but do not
count for the draw. A document without id has a weight but no score, and is not drawn. Equal scores go to
the smaller id; rows equal in both are drawn in any order. Empty tables give zero counts; without documents
the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralux.llm.common import IS_BREAK, LOWER, chunked_texts, cut, small_batches, spans

BUCKETS = 10_000
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Words of more bytes than this are summed one by one.
LONG = 64
#: Regular samples that a task hands on; rows of a sorted run, and how many of them one of its samples stands for.
SAMPLES = 64
RUN_ROWS = 65_536
SAMPLE_STEP = 256
#: Segments per square root of the number of rows that can be drawn.
SEGMENTS_PER_ROOT = 0.125

_MASK = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """What one byte does to a checksum: the reflected polynomial of zip files."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_STEP = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte ``k`` of value ``b`` of a checksum becomes when n zero bytes follow, n <= LONG."""
    found = np.zeros((LONG + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        found[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(LONG):
        found[n + 1] = _STEP[found[n] & np.uint32(255)] ^ (found[n] >> np.uint32(8))
    return found


_SHIFT = _shift_tables().reshape(-1)


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of two strings in a row, from theirs and the length (at most LONG) of the right one."""
    base = length.astype(np.int64) * 1024
    out = right.copy()
    for k in range(4):
        out ^= _SHIFT[base + 256 * k + ((left >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def with_space(sums: np.ndarray) -> np.ndarray:
    """Checksums of the strings with a space behind them."""
    state = sums ^ _MASK
    return _STEP[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)) ^ _MASK


def word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word, byte position by byte position for all words at once."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, sums = starts[order], np.full(len(starts), _MASK, dtype=np.uint32)
    longer = np.searchsorted(-length[order], -np.arange(1, LONG + 1), side="right")
    first = int(np.searchsorted(-length[order], -LONG, side="left"))
    for k, last in enumerate(longer):
        if last <= first:
            break
        state = sums[first:last]
        sums[first:last] = _STEP[(state ^ data[at[first:last] + k]) & np.uint32(255)] ^ (state >> np.uint32(8))
    out = np.empty(len(starts), dtype=np.uint32)
    out[order] = sums ^ _MASK
    for k in order[:first]:
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the row of each, and the words of each row, of lower-cased bytes and row offsets."""
    starts, ends, first = spans(data, offsets, IS_BREAK)
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    length = ends - starts
    single = run = word_sums(data, starts, ends)
    found, rows = [single], [row]
    for n in range(2, RUN + 1):
        if len(starts) < n:
            break
        last = slice(n - 1, None)
        short = length[last] <= LONG
        run = joined(with_space(run[:-1]), single[last], np.minimum(length[last], LONG))
        inside = row[n - 1 :] == row[: len(row) - n + 1]
        for k in np.flatnonzero(~short & inside):
            run[k] = zlib.crc32(b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(k, k + n)))
        found.append(run[inside])
        rows.append(row[n - 1 :][inside])
    return np.concatenate(found) % np.uint32(buckets), np.concatenate(rows), words


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, data, offsets in chunked_texts(batches, text):
            total += np.bincount(features(LOWER[data], offsets, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    # One row a bucket.
    for row in texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of the smoothed shares of each bucket."""
    n = len(raw)
    all_raw, all_target = float(raw.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (all_raw + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)],
        dtype=np.int64,
    )


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunked_texts(batches):
            bucket, row, words = features(LOWER[data], offsets, len(gains))
            many = np.bincount(row, minlength=len(words))
            # Sums of integers far below 2**53 are exact in doubles.
            weight = np.bincount(row, weights=gains[bucket], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(many), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """floor of 1000 Gumbel noise, from the hash of the seed and the id; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """(-score, id, row) as columns; smaller is better."""
    score, doc_id, row = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("score", "doc_id", "row"))
    return np.stack([-score, doc_id, row], axis=1)


def _sorted(keys: np.ndarray) -> np.ndarray:
    return keys[np.lexsort(keys.T[::-1])]


def segments_of(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many of the sorted splitters are smaller than each key."""
    both = np.concatenate([splitters, keys])
    mine = np.arange(len(both)) >= len(splitters)
    order = np.lexsort((~mine, *both.T[::-1]))
    out = np.empty(len(both), dtype=np.int64)
    out[order] = np.cumsum(~mine[order])
    return out[len(splitters) :]


def regular_splitters(rows: DataFrame, segments: int) -> np.ndarray:
    """Sorted keys that part ``rows`` into ``segments`` segments of nearly equal size."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = seen = 0

        def end_run() -> None:
            run = _sorted(np.concatenate(held))
            kept.append(run[min(len(run), SAMPLE_STEP) // 2 :: SAMPLE_STEP])

        for batch in batches:
            held.append(_keys(batch))
            n += len(held[-1])
            seen += len(held[-1])
            if n >= RUN_ROWS:
                end_run()
                held, n = [], 0
        if n:
            end_run()
        if seen:
            runs = _sorted(np.concatenate(kept))
            at = (np.arange(SAMPLES) * 2 + 1) * len(runs) // (2 * SAMPLES)
            picked = runs[np.unique(at)]
            yield pa.RecordBatch.from_arrays([*(pa.array(picked[:, k]) for k in range(3)), pa.array(np.full(len(picked), seen / len(picked)))], ["a", "b", "c", "stands_for"])

    # SAMPLES rows a task.
    found = rows.mapInArrow(sample, "a long, b long, c long, stands_for double").toArrow()
    keys = np.stack([found.column(c).to_numpy() for c in "abc"], axis=1).reshape(-1, 3)
    order = np.lexsort(keys.T[::-1])
    keys, upto = keys[order], np.cumsum(found.column("stands_for").to_numpy()[order])
    wanted = np.arange(1, segments) * (upto[-1] if len(upto) else 0) / segments
    return keys[np.unique(np.minimum(np.searchsorted(upto, wanted), len(keys) - 1))] if len(keys) else keys


def drawn_ranks(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``scored`` (doc_id, score, can_draw, row and others) with ``rank``, null where not drawn.

    ``row`` numbers the rows of a written table.
    """
    n = scored.where("can_draw").count()
    draw = percent * n // 100
    if not draw:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    splitters = regular_splitters(scored.where("can_draw").select("score", "doc_id", "row"), max(1, round(SEGMENTS_PER_ROOT * math.sqrt(n))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            can = batch.column(batch.schema.get_field_index("can_draw")).to_numpy(zero_copy_only=False).astype(bool)
            segment = np.full(len(can), -1, dtype=np.int64)
            segment[can] = segments_of(_keys(batch.filter(pa.array(can))), splitters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"])

    dealt = cut(scored.mapInArrow(deal, ", ".join(f"`{c}` {kind}" for c, kind in scored.dtypes) + ", segment long"), "dealt")
    counts = np.zeros(len(splitters) + 1, dtype=np.int64)
    # One row a segment.
    for row in dealt.where("segment >= 0").groupBy("segment").agg(F.count("*").alias("n")).collect():
        counts[row["segment"]] = row["n"]
    before = np.cumsum(counts) - counts
    last = int(np.flatnonzero(before < draw)[-1])
    shifts = dealt.sparkSession.createDataFrame([(k, int(before[k])) for k in range(last + 1)], "segment long, before long")
    within = F.row_number().over(W.partitionBy("segment").orderBy(F.desc("score"), "doc_id", "row"))
    taking = dealt.where(F.col("segment").between(0, last)).withColumn("local_rank", within)
    rank = (F.col("before") + F.col("local_rank")).cast("long")
    # The shifts have as many rows as there are segments, a fraction of the root of the number of documents.
    ranked = taking.join(F.broadcast(shifts), "segment").withColumn("rank", F.when(rank <= draw, rank))
    rest = dealt.where(~F.col("segment").between(0, last)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document's features, weight, score and rank among the drawn ones."""
    gains = bucket_gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    weighed = weights(docs, gains)
    can = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), can.alias("can_draw"), F.monotonically_increasing_id().alias("row"))
    return drawn_ranks(cut(scored, "scored"), percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn documents, whole, with their rank; ids must be unique."""
    ranks = resample(docs, target, percent, seed).where("rank IS NOT NULL").select("doc_id", "rank")
    return docs.drop("rank").join(ranks, "doc_id")
