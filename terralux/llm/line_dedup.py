"""Line dedup by prefix doubling over sequences of line ids.

A document is the sequence of its lines that are not blank; a line's id is the rank of its hash.
Prefix doubling ranks the runs of 1, 2, 4, ... lines at every place of all documents: the rank of
a run of 2h lines is the place of the pair (rank of its first h lines, rank of its last h
lines) in the sorted order of all pairs. Places of equal rank at h lines are an interval of the
suffix array whose longest common prefix is at least h lines; a place whose run is alone leaves
the game, as no longer run there can repeat.

A maximal repeated run counts from ``min_words`` words on. Its lines are exactly those in a
shortest run of ``min_words`` words that starts, or ends, at one of its lines and lies within
it, so doubling stops at the longest such run. A run of l lines, 2**k <= l < 2**(k + 1), is known
by the ranks of its first and its last 2**k lines. Each line of a run that also starts earlier
(smaller doc_id, or earlier in the document) is deleted; the first copy stays.

Ranks are of hashes, so "sorted order" is that of 64-bit line hashes. Deleted lines go with their
line feed. Null text stays null and empty text empty; a document that loses all lines keeps its row
with an empty text. Rows with a null id are left alone; rows with equal ids must be equal rows.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralux.llm.common import IS_SPACE, Rolling, bucket_count, chunked_texts, cut, small_batches, spans, text_bytes

MIN_WORDS = 50
_FEED = np.arange(256) == 10

LINES = "doc_id long, line int, hash long, words int"
STATE = "doc_id long, line int, words int, rank long"
STEP = "kind string, doc_id long, line int, words int, first long, last long, lines int"


def line_table(docs: DataFrame) -> DataFrame:
    """Lines with a word: their number among those of the document, hash and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunked_texts(batches):
            starts, ends, first = spans(data, offsets, _FEED)
            begins, _, _ = spans(data, offsets, IS_SPACE)
            words = np.searchsorted(begins, ends) - np.searchsorted(begins, starts)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            keep = words > 0
            doc, starts, ends, words = doc[keep], starts[keep], ends[keep], words[keep]
            counts = np.bincount(doc, minlength=len(offsets) - 1)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.column(0).to_numpy()[doc]), pa.array(number.astype(np.int32)), pa.array(Rolling(data).of(starts, ends).view(np.int64)), pa.array(words.astype(np.int32))],
                ["doc_id", "line", "hash", "words"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, LINES)


def ranked(keys: DataFrame) -> DataFrame:
    """Keys (columns first, last, n) with the number of places before them in sorted order.

    Range-partitioned and sorted; each partition adds the sums of those before it.
    """
    spark = keys.sparkSession

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(before), pa.array(np.full(len(n), part))], ["first", "last", "n", "before", "part"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(
        keys.repartitionByRange(parts, "first", "last").sortWithinPartitions("first", "last").mapInArrow(local, "first long, last long, n long, before long, part long"),
        "ranks",
    )
    sums = {r[0]: r[1] for r in ordered.groupBy("part").agg(F.sum("n")).collect()}
    shift, at = [], 0
    for p in sorted(sums):
        shift += [F.lit(p), F.lit(at)]
        at += sums[p]
    if not shift:
        return ordered.select("first", "last", F.col("before").alias("rank"))
    return ordered.select("first", "last", (F.col("before") + F.create_map(*shift)[F.col("part")]).alias("rank"))


def needed_runs(doc: np.ndarray, line: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortest runs of ``min_words`` words from each line on and up to each line: first places and sizes.

    Runs stay within neighbouring lines of one document.
    """
    n = len(doc)
    joined = np.zeros(n, dtype=bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (line[1:] == line[:-1] + 1)
    segment = np.cumsum(~joined)
    sums = np.concatenate([[0], np.cumsum(words)])
    place = np.arange(n)
    end = np.searchsorted(sums, sums[:-1] + min_words, side="left")  # first end with enough words
    ahead = (end <= n) & (segment[np.minimum(end, n) - 1] == segment)
    begin = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
    behind = (begin >= 0) & (segment[np.maximum(begin, 0)] == segment)
    runs = np.concatenate([np.stack([place[ahead], end[ahead] - place[ahead]]), np.stack([begin[behind], place[behind] + 1 - begin[behind]])], axis=1)
    runs = np.unique(runs, axis=1) if runs.shape[1] else runs
    return runs[0], runs[1]


def _step(size: int, min_words: int):
    """Pairs to rank next and runs that this level settles, of the documents of one part."""

    def run(table: pa.Table) -> pa.Table:
        doc, line, words, rank = (table.column(c).to_numpy() for c in ("doc_id", "line", "words", "rank"))
        order = np.lexsort((line, doc))
        doc, line, words, rank = doc[order], line[order], words[order], rank[order]
        n = len(doc)
        other = np.full(n, -1, dtype=np.int64)
        if n > size:
            same = (doc[size:] == doc[:-size]) & (line[size:] == line[:-size] + size)
            other[:-size] = np.where(same, rank[size:], -1)
        first, lines = needed_runs(doc, line, words, min_words)
        mine = (lines >= size) & (lines < 2 * size)
        first, lines = first[mine], lines[mine]
        last = first + lines - size
        known = (rank[first] >= 0) & (rank[last] >= 0)
        first, last, lines = first[known], last[known], lines[known]
        longest = lines.max() if len(lines) else 0
        pairs = {"kind": np.full(n, "pair"), "doc_id": doc, "line": line, "words": words, "first": np.where(other >= 0, rank, -1), "last": other, "lines": np.full(n, longest)}
        runs = {"kind": np.full(len(first), "run"), "doc_id": doc[first], "line": line[first], "words": words[first], "first": rank[first], "last": rank[last], "lines": lines}
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        return pa.table([pa.array(np.concatenate([pairs[c], runs[c]]), k) for c, k in zip(pairs, kinds, strict=True)], names=list(pairs))

    return run


def _longest_run(min_words: int):
    def run(table: pa.Table) -> pa.Table:
        doc, line, words = (table.column(c).to_numpy() for c in ("doc_id", "line", "words"))
        order = np.lexsort((line, doc))
        _, lines = needed_runs(doc[order], line[order], words[order], min_words)
        return pa.table({"lines": pa.array([int(lines.max()) if len(lines) else 0], pa.int32())})

    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line, lines): runs of at least ``min_words`` words that also start earlier; their union is what repeats."""
    small_batches(docs.sparkSession)
    parts = bucket_count(text_bytes(docs), 32_000_000)
    lines = line_table(docs)
    hashes = lines.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    names = ranked(hashes.select(F.col("hash").alias("first"), F.lit(0).cast("long").alias("last"), "n"))
    state = lines.join(names.select(F.col("first").alias("hash"), "rank"), "hash").select("doc_id", "line", "words", "rank")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    state = cut(state.withColumn("part", part), "lines")
    longest = state.groupBy("part").applyInArrow(_longest_run(min_words), "lines int").agg(F.max("lines")).first()[0] or 0
    settled, size = [], 1
    while size <= longest:
        step = cut(state.groupBy("part").applyInArrow(_step(size, min_words), STEP), "step")
        runs = step.where("kind = 'run'").select("doc_id", "line", "lines", "first", "last")
        settled.append(runs.withColumn("size", F.lit(size)))
        size *= 2
        if size > longest:
            break
        pairs = step.where("kind = 'pair'")
        names = ranked(pairs.where("last >= 0 and first >= 0").groupBy("first", "last").agg(F.count("*").alias("n")).where("n > 1"))
        state = cut(
            pairs.join(names, ["first", "last"], "left").select("doc_id", "line", "words", F.coalesce("rank", F.lit(-1)).alias("rank")).withColumn("part", part), "lines"
        )
    if not settled:
        return docs.sparkSession.createDataFrame([], "doc_id long, line int, lines int")
    runs = settled[0]
    for more in settled[1:]:
        runs = runs.unionByName(more)
    key = ["size", "lines", "first", "last"]
    origin = runs.groupBy(*key).agg(F.min(F.struct("doc_id", "line")).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = runs.join(origin, key).where("doc_id > origin.doc_id or line > origin.line")
    return cut(found.select("doc_id", "line", "lines"), "repeated-runs")


def delete_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the lines of repeated runs; all columns stay, ``n_chars`` follows the text."""
    runs = repeated_runs(docs, min_words)
    gone = runs.select(F.col("doc_id").alias("_gone_id"), F.struct("line", "lines").alias("run")).groupBy("_gone_id").agg(F.collect_list("run").alias("_gone_runs"))
    names = docs.columns
    text = names.index("text")
    # Joined in the same way at every size: runs grow with the texts.
    joined = docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone_id"], "left").drop("_gone_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for k, spans_ in enumerate(batch.column(len(names)).to_pylist()):
                if spans_ and texts[k] is not None:
                    texts[k] = without_lines(texts[k], spans_)
            columns = [pa.array(texts, pa.string()) if k == text else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def without_lines(text: str, runs: list[dict]) -> str:
    """``text`` without these runs of its lines (numbered without blank ones)."""
    lines, number, gone = text.split("\n"), 0, set()
    for r in runs:
        gone.update(range(r["line"], r["line"] + r["lines"]))
    kept = []
    for line in lines:
        blank = not line.strip(" \t\x0b\x0c\r")
        if blank or number not in gone:
            kept.append(line)
        number += not blank
    return "\n".join(kept) if any(x.strip(" \t\x0b\x0c\r") for x in kept) else ""
