"""Deleted interpolation: a bigram language model mixed by context frequency.

    P(w | v) = l2[b(v)] * c(v w) / c(v) + (1 - l2[b(v)]) * P(w)
    P(w)     = l1 * c(w) / N + (1 - l1) / (V + 1)

b(v) is the bucket of the context's frequency (its number of binary digits). The weights are
learned by expectation-maximisation on held-out counts: one tenth of the training documents
(the development fold) is deleted from the counts, and the weights are those under which it
is likeliest. For the final model the counts are whole again. Expectation-maximisation
needs of a token only the bucket and the ratio of the two estimates it mixes; tokens are
gathered by bucket and ratio, ratios to one part in 45, so that the counts the driver iterates
over are bounded whatever the corpus is.

Words are hashed to 64 bits; a bigram is known by its bucket and 48 further bits. Documents are
handled in blocks of about ``BLOCK_TOKENS`` tokens. A block sends its different unigrams and
bigrams, counted, to the bucket of each key; the bucket sums over all blocks and answers every
block with the corpus counts of the keys it asked for, in its order. A frequent word thus
travels once per block.

A null or empty text is the end token alone. Repeated rows are documents of their own. A null id
belongs to the training documents. An empty table gives an empty result; without training
tokens every estimate is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralux.llm.common import (
    bucket_count,
    chunked_texts,
    cut,
    dealt,
    free_memory,
    from_varint,
    IS_SPACE,
    LOWER,
    mix,
    remainder,
    Rolling,
    small_batches,
    spans,
    take_arrays,
    text_bytes,
    to_varint,
)

FOLDS = 10
HELD_OUT, DEVELOPMENT = 0, 1
BLOCK_TOKENS = 400_000
#: Blocks that are sent to Python together.
BATCH_BLOCKS = 16
#: Steps of the logarithm of a ratio, per doubling.
RATIO_STEPS = 32
RATIO_SPAN = 64 * RATIO_STEPS
EM_ROUNDS = 60
END, BEGIN = np.uint64(1), np.uint64(2)

@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows, for tables whose rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


BLOCKS = "block long, development boolean, ids binary, nulls binary, folds binary, sizes binary, words binary, tokens binary"
REQUESTS = "bucket long, block long, development boolean, unigrams binary, unigram_counts binary, bigrams binary, bigram_counts binary"
ANSWERS = (
    "bucket long, block long, development boolean, unigrams binary, bigrams binary, "
    "n long, n_less long, v long, v_less long, bins array<int>, weights array<long>"
)


class _Block:
    """Tokens of documents, as places in the sorted list of the block's words."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.nulls = np.frombuffer(row["nulls"], dtype=bool)
        self.folds = np.frombuffer(row["folds"], dtype=np.int8)
        self.sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        self.words = np.frombuffer(row["words"], dtype=np.uint64)
        self.tokens = np.frombuffer(row["tokens"], dtype=np.int32).astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        self.contexts = np.empty_like(self.tokens)
        self.contexts[1:] = self.tokens[:-1]
        self.begin = len(self.words)
        self.contexts[first] = self.begin
        self.first = first
        self.training = np.repeat(self.folds != HELD_OUT, self.sizes)
        self.pairs, self.pair_of = _distinct(self.contexts * (self.begin + 1) + self.tokens, (self.begin + 1) ** 2)
        hashes = np.append(self.words, BEGIN)
        left, right = hashes[self.pairs // (self.begin + 1)], hashes[self.pairs % (self.begin + 1)]
        keys = mix(left * np.uint64(0xD6E8FEB86659FD93) + right, 2)
        # In the order of their keys, so that a bucket's keys are sent as differences.
        order = np.argsort(keys)
        self.bigrams = keys[order]
        self.left = (self.pairs // (self.begin + 1))[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.pair_of = place[self.pair_of]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the training tokens: unigrams and bigrams."""
        return (
            np.bincount(self.tokens[self.training], minlength=len(self.words)),
            np.bincount(self.pair_of[self.training], minlength=len(self.bigrams)),
        )


def _distinct(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and each value's place, by one sort of value and index in a word where they fit."""
    n = len(codes)
    shift = max(1, int(n).bit_length())
    if not n or int(limit).bit_length() + shift > 63:
        return np.unique(codes, return_inverse=True)
    packed = np.sort((codes << shift) | np.arange(n))
    index, codes = packed & ((1 << shift) - 1), packed >> shift
    new = np.concatenate([[True], codes[1:] != codes[:-1]])
    place = np.empty(n, dtype=np.int64)
    place[index] = np.cumsum(new) - 1
    return codes[new], place


class _Gathered:
    def __init__(self):
        self.ids, self.nulls, self.folds, self.sizes, self.hashes, self.n = [], [], [], [], [], 0

    def add(self, ids, nulls, folds, sizes, hashes) -> None:
        for into, x in zip((self.ids, self.nulls, self.folds, self.sizes, self.hashes), (ids, nulls, folds, sizes, hashes), strict=True):
            into.append(x)
        self.n += len(hashes)

    def row(self, block: int, development: bool) -> pa.RecordBatch:
        ids, nulls, folds, sizes, hashes = (np.concatenate(x) for x in (self.ids, self.nulls, self.folds, self.sizes, self.hashes))
        words, tokens = np.unique(hashes, return_inverse=True)
        values = [block, development, ids.tobytes(), nulls.tobytes(), folds.astype(np.int8).tobytes(), sizes.astype(np.int64).tobytes(), words.tobytes(), tokens.astype(np.int32).tobytes()]
        kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])


def token_blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks of hashed tokens; those of the development fold in blocks of their own."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, base = 0, TaskContext.get().partitionId() << 32
        open_ = {False: _Gathered(), True: _Gathered()}
        for part, data, offsets in chunked_texts(batches):
            data = LOWER[data]
            starts, ends, first = spans(data, offsets, IS_SPACE)
            hashes = Rolling(data).of(starts, ends)
            counts = np.diff(first)
            # The end token behind each document's words.
            tokens = np.insert(hashes, first[1:], END)
            column = part.column(0)
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            ids = column.fill_null(0).to_numpy()
            folds = part.column(2).to_numpy()
            doc_of = np.repeat(np.arange(len(counts)), counts + 1)
            for development in (False, True):
                mine = (folds == DEVELOPMENT) == development
                if mine.any():
                    gathered = open_[development]
                    gathered.add(ids[mine], nulls[mine], folds[mine], (counts + 1)[mine], tokens[mine[doc_of]])
                    if gathered.n >= BLOCK_TOKENS:
                        yield gathered.row(base + made, development)
                        made, open_[development] = made + 1, _Gathered()
        for development, gathered in open_.items():
            if gathered.n:
                yield gathered.row(base + made, development)
                made += 1

    return docs.select(F.col("doc_id").cast("long"), "text", remainder(FOLDS).cast("int").alias("fold")).mapInArrow(run, BLOCKS)


def _requests(n_buckets: int):
    names = [x.split()[0] for x in REQUESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block at a time: a batch may hold all blocks of a partition.
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = _Block(row)
                unigrams, bigrams = block.counts()
                ones, twos = dict(dealt(block.words, n_buckets)), dict(dealt(block.bigrams, n_buckets))
                none = np.zeros(0, dtype=np.int64)
                out = []
                for b in sorted(ones.keys() | twos.keys()):
                    i, j = ones.get(b, none), twos.get(b, none)
                    out.append(
                        (
                            b,
                            row["block"],
                            row["development"],
                            block.words[i].tobytes(),
                            to_varint(unigrams[i]),
                            to_varint(np.diff(block.bigrams[j] >> np.uint64(16), prepend=np.uint64(0))),
                            to_varint(bigrams[j]),
                        )
                    )
                kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)
                del row, block, ones, twos, out
        free_memory()

    return run


def _totals(keys: np.ndarray, counts: np.ndarray, development: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each key among the different ones, their counts, and those of the development fold."""
    different, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, counts, len(different)).astype(np.int64)
    return place, total, np.bincount(place, counts * development, len(different)).astype(np.int64)


def _count(table: pa.Table) -> pa.Table:
    """All requests of a bucket: corpus counts for each, in the order asked."""
    # Keys are views of the table's buffers.
    rows = table.select(["bucket", "block", "development"]).to_pylist()
    unigrams = take_arrays(table.column("unigrams"), np.uint64)
    bigrams = [np.cumsum(from_varint(x.as_buffer())) for x in table.column("bigrams")]
    answers = {}
    stats = {}
    for name, keys in (("unigrams", unigrams), ("bigrams", bigrams)):
        sizes = [len(k) for k in keys]
        counts = np.concatenate([from_varint(x.as_buffer()) for x in table.column(name[:-1] + "_counts")])
        development = np.repeat(np.array([r["development"] for r in rows]), sizes)
        place, total, part = _totals(np.concatenate(keys), counts, development)
        edges = np.cumsum(sizes)[:-1]
        answers[name] = [to_varint(np.concatenate([t[p], d[p]])) for p, t, d in ((p, total, part) for p in np.split(place, edges))]
        if name == "unigrams":
            less = total - part
            seen = part > 0
            bins, weights = np.unique(_steps(less[seen]), return_inverse=True)
            stats = {
                "n": int(total.sum()),
                "n_less": int(less.sum()),
                "v": int((total > 0).sum()),
                "v_less": int((less > 0).sum()),
                "bins": bins.tolist(),
                "weights": np.bincount(weights, part[seen], len(bins)).astype(np.int64).tolist(),
            }
    nothing = {"n": 0, "n_less": 0, "v": 0, "v_less": 0, "bins": [], "weights": []}
    out = [
        {"bucket": r["bucket"], "block": r["block"], "development": r["development"], "unigrams": answers["unigrams"][k], "bigrams": answers["bigrams"][k], **(nothing if k else stats)}
        for k, r in enumerate(rows)
    ]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.Table.from_pylist(out, pa.schema(list(zip([x.split()[0] for x in ANSWERS.split(", ")], kinds, strict=True))))


def _steps(ratio: np.ndarray) -> np.ndarray:
    """Steps of a ratio's logarithm; ``-RATIO_SPAN`` for 0."""
    with np.errstate(divide="ignore"):
        steps = np.round(np.log2(ratio.astype(np.float64)) * RATIO_STEPS)
    return np.clip(np.nan_to_num(steps, neginf=-RATIO_SPAN), -RATIO_SPAN, RATIO_SPAN).astype(np.int32)


def _ratio(steps: np.ndarray) -> np.ndarray:
    return np.where(steps <= -RATIO_SPAN, 0.0, np.exp2(steps / RATIO_STEPS))


def learn_weight(steps: np.ndarray, counts: np.ndarray) -> float:
    """Expectation-maximisation of the weight of the first of two estimates, from counts by their ratio."""
    if not counts.sum():
        return 0.0
    ratio, weight = _ratio(steps), 0.5
    for _ in range(EM_ROUNDS):
        weight = float((counts * weight * ratio / (weight * ratio + 1 - weight)).sum() / counts.sum())
        weight = min(weight, 1 - 1e-6)
    return weight


class _Counts:
    """Corpus counts of what a block holds."""

    def __init__(self, block: _Block, answers: list[dict], n_buckets: int):
        by_bucket = {a["bucket"]: a for a in answers}
        self.c, self.c_less = (np.zeros(len(block.words), dtype=np.int64) for _ in range(2))
        self.cc, self.cc_less = (np.zeros(len(block.bigrams), dtype=np.int64) for _ in range(2))
        for keys, name, total, less in ((block.words, "unigrams", self.c, self.c_less), (block.bigrams, "bigrams", self.cc, self.cc_less)):
            for b, index in dealt(keys, n_buckets):
                both = from_varint(by_bucket[b][name]).reshape(2, -1)
                total[index], less[index] = both[0], both[0] - both[1]
        # Every document begins once and ends once.
        end = np.searchsorted(block.words, END)
        self.context, self.context_less = (np.append(x, x[end]) for x in (self.c, self.c_less))


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    """Number of binary digits; 0 for a context that was never seen."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def interpolation_scores(docs: DataFrame) -> DataFrame:
    """Per document: tokens, known tokens, the add-0.1 unigram base score and the model's score."""
    n_buckets = bucket_count(text_bytes(docs))
    blocks = cut(token_blocks(docs), "lm-blocks")
    with few_rows(docs.sparkSession, BATCH_BLOCKS):
        answers = cut(blocks.mapInArrow(_requests(n_buckets), REQUESTS).groupBy("bucket").applyInArrow(_count, ANSWERS), "lm-counts")
    n, n_less, v, v_less = (x or 0 for x in answers.agg(*(F.sum(c) for c in ("n", "n_less", "v", "v_less"))).first())

    # Unigram weight: ratio of c / N to 1 / (V + 1) over the development tokens.
    seen = answers.where("size(bins) > 0").select(F.explode(F.arrays_zip("bins", "weights")).alias("x")).groupBy("x.bins").agg(F.sum("x.weights").alias("w")).collect()
    steps, counts = np.array([r[0] for r in seen], dtype=np.int64), np.array([r[1] for r in seen], dtype=np.float64)
    shift = round(np.log2((v_less + 1) / n_less) * RATIO_STEPS) if n_less else 0
    first_weight = learn_weight(np.where(steps > -RATIO_SPAN, np.clip(steps + shift, 1 - RATIO_SPAN, RATIO_SPAN), -RATIO_SPAN), counts)

    def base(c: np.ndarray, n: int, v: int) -> np.ndarray:
        return (first_weight * c / n if n else 0.0 * c) + (1 - first_weight if n else 1.0) / (v + 1)

    def ratios(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        for row in left.to_pylist():
            block = _Block(row)
            have = _Counts(block, right.to_pylist(), n_buckets)
            context = have.context_less[block.contexts]
            ml = have.cc_less[block.pair_of] / np.maximum(context, 1)
            step = _steps(ml / base(have.c_less, n_less, v_less)[block.tokens])
            found.append(frequency_bucket(context) * (4 * RATIO_SPAN) + step + RATIO_SPAN)
        code, weight = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), return_counts=True)
        return pa.table({"bucket": code // (4 * RATIO_SPAN), "step": code % (4 * RATIO_SPAN) - RATIO_SPAN, "n": weight.astype(np.int64)})

    pairs = blocks.where("development").groupBy("block").cogroup(answers.where("development").drop("n", "n_less", "v", "v_less", "bins", "weights").groupBy("block"))
    # At most 64 buckets times 2 * RATIO_SPAN ratios.
    gathered = pairs.applyInArrow(ratios, "bucket long, step long, n long").groupBy("bucket", "step").agg(F.sum("n").alias("n")).collect()
    weights = np.zeros(65)
    for bucket in {r["bucket"] for r in gathered if r["bucket"] > 0}:
        mine = [r for r in gathered if r["bucket"] == bucket]
        weights[bucket] = learn_weight(np.array([r["step"] for r in mine]), np.array([r["n"] for r in mine], dtype=np.float64))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = _Block(row)
            have = _Counts(block, right.to_pylist(), n_buckets)
            context = have.context[block.contexts]
            weight = weights[frequency_bucket(context)]
            p = weight * have.cc[block.pair_of] / np.maximum(context, 1) + (1 - weight) * base(have.c, n, v)[block.tokens]
            plain = np.log10((have.c + 0.1) / (n + 0.1 * (v + 1)))[block.tokens]
            known = (have.c > 0)[block.tokens]
            sums = [np.add.reduceat(x, block.first) for x in (known.astype(np.int64), plain, np.log10(p))]
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(block.ids, mask=block.nulls),
                        "held_out": block.folds == HELD_OUT,
                        "n_tokens": block.sizes,
                        "n_known": sums[0],
                        "train_tokens": np.full(len(block.ids), n, dtype=np.int64),
                        "base_score": sums[1],
                        "score": sums[2],
                    }
                )
            )
        return pa.concat_tables(out)

    both = blocks.groupBy("block").cogroup(answers.drop("n", "n_less", "v", "v_less", "bins", "weights").groupBy("block"))
    return both.applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
