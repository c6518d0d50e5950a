"""Benchmark decontamination with an FM-index per shard of the training text.

Words are maximal runs of letters and digits (ASCII) and of all other characters beyond ASCII,
A-Z lower-cased. A window is ``width`` consecutive words of a benchmark item, or the whole item
where it has fewer (but any) words. Each shard of documents is searched through an FM-index:
suffix array, Burrows-Wheeler transform, wavelet-matrix ranks for backward search, and sampled
suffix positions to locate the occurrences. Their spans are merged per document.

A shard's index holds only runs of words that occur in the benchmark, and only those as long as
the shortest window: no occurrence can lie elsewhere. The benchmark itself travels to the
tasks, in blocks of about ``QUERY_BYTES`` of text (an item is never cut) that are searched for one after another,
so that driver and workers hold the windows of one block; with several, document rows are numbered, each block's
hits are written, and spans are merged over the blocks by that number. Documents are read once a block.

Null text or no words: zero counts and not contaminated. Null or repeated item ids: a null id does
not take part; rows of the same id count as one item. Repeated document rows give repeated result
rows. Empty tables give empty results or zero counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralux import session
from terralux.llm.common import IS_BREAK, LOWER, Rolling, byte_view, chunked_texts, cut, group_ranks, small_batches, spans

WIDTH = 13
#: A document is contaminated from this share of its words on: 1 / 20.
SHARE = 20
#: Text of benchmark items that is searched for at once.
QUERY_BYTES = 500_000
#: Words of documents in one index.
SHARD_WORDS = 1_000_000
#: One of so many suffix positions is kept for locating.
SAMPLE = 8


class WaveletMatrix:
    """Ranks of any symbol at any place of a sequence: one bit vector per level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, dtype=np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, len(sequence) - int(ones[-1])))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros(len(symbols), dtype=np.int64), places.astype(np.int64)
        for level, ones, zeros in self.levels:
            one = ((symbols >> level) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def at(self, places: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        out, places = np.zeros(len(places), dtype=np.int64), places.astype(np.int64)
        for level, ones, zeros in self.levels:
            before = ones[places]
            one = ones[places + 1] > before
            out |= one.astype(np.int64) << level
            places = np.where(one, zeros + before, places - before)
        return out


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Prefix doubling over integers; the last symbol must be unique and smallest."""
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    change = np.ones(n, dtype=np.int64)
    change[1:] = sequence[order][1:] != sequence[order][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(change) - 1
    step = 1
    while step < n and rank[order[-1]] < n - 1:
        following = np.zeros(n, dtype=np.int64)
        following[: n - step] = rank[step:] + 1
        pair = rank * (n + 1) + following
        order = np.argsort(pair, kind="stable")
        change[1:] = pair[order][1:] != pair[order][:-1]
        rank[order] = np.cumsum(change) - 1
        step *= 2
    return order


class FMIndex:
    """Backward search over a sequence of symbols from 1 to ``n_symbols`` (0 ends it)."""

    def __init__(self, sequence: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        text = np.append(sequence, 0).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.first = np.zeros(n_symbols + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols + 1), out=self.first[1:])
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(n_symbols).bit_length()))
        self.kept = np.zeros(self.n + 1, dtype=np.int64)
        marked = order % sample == 0
        np.cumsum(marked, out=self.kept[1:])
        self.samples = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each pattern (rows, right-aligned)."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1]
        for k in range(width - 1, -1, -1):
            live = np.flatnonzero((width - k <= lengths) & (low < high))
            symbols = patterns[live, k]
            base = self.first[symbols]
            low[live] = base + self.bwt.rank(symbols, low[live])
            high[live] = base + self.bwt.rank(symbols, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to the nearest sampled position."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), dtype=np.int64)
        out = np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            known = self.kept[at + 1] > self.kept[at]
            done = open_[known]
            out[done] = self.samples[self.kept[rows[done]]] + steps[done]
            open_ = open_[~known]
            symbols = self.bwt.at(rows[open_])
            rows[open_] = self.first[symbols] + self.bwt.rank(symbols, rows[open_])
            steps[open_] += 1
        return out


class Windows:
    """Windows of a block of items as rows of symbols."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        texts = pa.array([t for _, t in items], pa.string())
        data, offsets = byte_view(texts)
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, IS_BREAK)
        hashes = Rolling(data).of(starts, ends)
        self.words, symbols = np.unique(hashes, return_inverse=True)
        rows, lengths, owners = [], [], []
        for k in range(len(items)):
            own = symbols[first[k] : first[k + 1]] + 1
            if len(own):
                size = min(width, len(own))
                view = np.lib.stride_tricks.sliding_window_view(own, size)
                block = np.zeros((len(view), width), dtype=np.int64)
                block[:, width - size :] = view
                rows.append(block)
                lengths += [size] * len(view)
                owners += [k] * len(view)
        self.patterns = np.concatenate(rows) if rows else np.zeros((0, width), dtype=np.int64)
        self.lengths, self.owners = np.array(lengths, dtype=np.int64), np.array(owners, dtype=np.int64)
        self.item_ids = [i for i, _ in items]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        # Equal windows are searched for once.
        self.distinct, self.which = np.unique(self.patterns, axis=0, return_inverse=True) if len(rows) else (self.patterns, np.zeros(0, dtype=np.int64))
        self.which = self.which.reshape(-1)
        self.sizes = (self.distinct > 0).sum(axis=1)


class _Shard:
    """Documents and their words until the shard is full, then one search over all."""

    def __init__(self, windows: Windows):
        self.windows, self.ids, self.counts, self.symbols = windows, [], [], []
        self.size = 0

    def add(self, ids: list, symbols: np.ndarray, first: np.ndarray) -> None:
        self.ids += ids
        self.counts.append(np.diff(first))
        self.symbols.append(symbols)
        self.size += len(symbols)

    def hits(self) -> Iterator[tuple]:
        """(doc_id, n_words, starts, ends, item numbers) of each document."""
        w = self.windows
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(counts)
        symbols = np.concatenate(self.symbols) if self.symbols else np.zeros(0, dtype=np.int64)
        doc_of = np.repeat(np.arange(len(counts)), counts)
        found_from, found_to, found_item = self._occurrences(symbols, doc_of)
        order = np.argsort(found_from, kind="stable")
        found_from, found_to, found_item = found_from[order], found_to[order], found_item[order]
        bounds = np.searchsorted(found_from, ends)
        at = 0
        for k, (doc_id, n) in enumerate(zip(self.ids, counts, strict=True)):
            a, at = at, int(bounds[k])
            begin = int(ends[k]) - int(n)
            if a == at:
                yield doc_id, int(n), [], [], []
                continue
            starts, stops = merge(found_from[a:at] - begin, found_to[a:at] - begin)
            yield doc_id, int(n), starts, stops, np.unique(found_item[a:at]).tolist()

    def _occurrences(self, symbols: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, none = self.windows, np.zeros(0, dtype=np.int64)
        if not len(symbols) or not len(w.distinct):
            return none, none, none
        # Runs of benchmark words in a document, at least as long as the shortest window.
        known = symbols > 0
        change = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (doc_of[1:] != doc_of[:-1])]))
        lengths = np.diff(np.append(change, len(symbols)))
        keep = known[change] & (lengths >= w.shortest)
        begins, lengths = change[keep], lengths[keep]
        if not len(begins):
            return none, none, none
        separator = len(w.words) + 1
        total = int((lengths + 1).sum())
        text, origin = np.full(total, separator, dtype=np.int64), np.full(total, -1, dtype=np.int64)
        place = np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths) + group_ranks(lengths)
        source = np.repeat(begins, lengths) + group_ranks(lengths)
        text[place], origin[place] = symbols[source], source
        index = FMIndex(text, separator)
        low, high = index.search(w.distinct, w.sizes)
        n = high - low
        some = np.flatnonzero(n)
        if not len(some):
            return none, none, none
        at = index.locate(np.repeat(low[some], n[some]) + group_ranks(n[some]))
        pattern = np.repeat(some, n[some])
        # Each window's items: windows that items share are given to all of them.
        by_pattern = np.argsort(w.which, kind="stable")
        bounds = np.searchsorted(w.which[by_pattern], np.arange(len(w.distinct) + 1))
        shared = (bounds[1:] - bounds[:-1])[pattern]
        item = w.owners[by_pattern[np.repeat(bounds[pattern], shared) + group_ranks(shared)]]
        start = np.repeat(origin[at], shared)
        return start, start + np.repeat(w.sizes[pattern], shared), item


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of half-open spans, ordered."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > reach[:-1]) + 1
    return starts[np.concatenate([[0], cut])].tolist(), reach[np.concatenate([cut - 1, [len(reach) - 1]])].tolist()


SPANS = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _query_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded text; the rows stream through the driver partition by partition."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= limit:
            yield block
            block, size = [], 0
    yield block


def contamination_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Per document row: words, merged spans of hit words, and ids of the items found in it."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = _query_blocks(benchmark, query_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is not None:
        # Written once: every block sees the same numbers.
        docs = cut(docs.withColumn("row_number", F.monotonically_increasing_id()), "rows")

    def search(windows: Windows):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = _Shard(windows)
            for part, data, offsets in chunked_texts(batches):
                data = LOWER[data]
                starts, ends, first = spans(data, offsets, IS_BREAK)
                hashes = Rolling(data).of(starts, ends)
                at = np.searchsorted(windows.words, hashes)
                at[at == len(windows.words)] = 0
                known = windows.words[at] == hashes if len(windows.words) else np.zeros(len(hashes), dtype=bool)
                shard.add(part.column(0).to_pylist(), np.where(known, at + 1, 0), first)
                if shard.size >= SHARD_WORDS:
                    yield _rows(shard, windows)
                    shard = _Shard(windows)
            if shard.ids:
                yield _rows(shard, windows)

        return run

    if second is None:
        return docs.mapInArrow(search(Windows(first, width)), SPANS)
    numbered = docs.select(F.col("row_number").alias("doc_id"), "text")
    path = session.scratch_path(docs.sparkSession, "hits")
    for k, block in enumerate(chain([first, second], blocks)):
        # Written before the next block is read: the driver and the workers hold the windows of one at a time.
        hits = numbered.mapInArrow(search(Windows(block, width)), SPANS)
        (hits.where("size(starts) > 0") if k else hits).write.mode("append").parquet(path)
    merged = _merged(docs.sparkSession.read.schema(SPANS).parquet(path))
    ids = docs.select("row_number", F.col("doc_id").alias("id"))
    return merged.join(ids, merged["doc_id"] == ids["row_number"]).select(F.col("id").alias("doc_id"), "n_words", "starts", "ends", "items")


def _rows(shard: _Shard, windows: Windows) -> pa.RecordBatch:
    columns = list(zip(*shard.hits(), strict=True))
    items = [[windows.item_ids[i] for i in found] for found in columns[4]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
    arrays = [pa.array(c, k) for c, k in zip([*columns[:4], items], kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "starts", "ends", "items"])


def _merged(rows: DataFrame) -> DataFrame:
    """Spans of several query blocks, merged per document row, by its number as doc_id."""
    together = rows.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.flatten(F.collect_list("items")).alias("items"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pydict()
            for k, (a, b) in enumerate(zip(table["starts"], table["ends"], strict=True)):
                if a:
                    table["starts"][k], table["ends"][k] = merge(np.array(a), np.array(b))
            yield pa.RecordBatch.from_pydict(table, batch.schema)

    return together.mapInArrow(run, SPANS)


def judge(found: DataFrame) -> DataFrame:
    """Digest of the spans: hit words, items and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pydict()
            hit = [sum(b) - sum(a) for a, b in zip(t["starts"], t["ends"], strict=True)]
            items = [sorted(set(i)) for i in t["items"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t["doc_id"], pa.int64()),
                    pa.array(t["n_words"], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(i) for i in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                    pa.array([h > 0 and SHARE * h >= n for h, n in zip(hit, t["n_words"], strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    return judge(contamination_spans(docs, benchmark, width))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that are not contaminated; all columns stay. Rows with a null id stay."""
    bad = contamination(docs, benchmark, width).where("contaminated").select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad.hint("merge"), docs["doc_id"] == bad["_bad_id"], "left_anti")
