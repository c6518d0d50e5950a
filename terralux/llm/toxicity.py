"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two rows of one table: that of the word's hash and that of the
hash of its first ``PREFIX`` bytes. Filters of several widths run over the words of a text, each
keeps its largest value over the whole text (or 0), and a logistic unit weighs them. Training is
Adam over batches of texts; gradients flow through the places of the maxima only.

The classifier learns from every labelled text. Texts are dealt to buckets by their id, where they become word rows; buckets
make up parts of about ``PART_WORDS`` words. In each of ``ROUNDS`` rounds all parts train the same network on their
own, and the changes are averaged: a row of the table over the parts that met it, all else over all parts. Sums of ``FAN``
parts are added to sums of more, so no group grows with the number of parts. Classes weigh the same while training; the
bias is then moved to the classes' shares.

For thresholds, one labelled text in ``CALIBRATION`` is not trained on. All of these are scored and counted by language and by score
in steps of 1 / ``BINS``; a language's threshold is where F1 is best (0.5 for languages with few texts). Every text is read and scored whole.
A caller may bound the training instead (``train_docs``, ``train_bytes``): then texts are drawn by a hash of their ids and trained on at the driver,
one in ``CALIBRATION`` of them is for thresholds, and texts are weighted by their class's sampling rate.

Null and empty texts get the score of a text without words. Null labels teach nothing; with labels of one
class only, every score is that class's share. Repeated rows are scored one by one; empty tables give empty
results.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralux.llm.common import IS_BREAK, LOWER, Rolling, bucket_count, byte_view, chunked_texts, chunks, cut, mix, remainder, small_batches, spans, text_bytes

FOLDS, HELD_OUT = 5, 0
#: Words of labelled texts that are trained on together, about, and rounds after which parts are averaged.
PART_WORDS, ROUNDS = 2_500_000, 2
#: Parts whose changes are summed together, and rows of a network's state that are summed together.
FAN, SLICE = 32, 2_048
CALIBRATION = 6
ROWS, DIMENSIONS, FILTERS, WIDTHS, PREFIX = 1 << 15, 12, 8, (1, 2, 3), 5
EPOCHS, BATCH, RATE = 4, 32, 0.01
#: With few texts, passes go on until so many batches were seen; a word is left out of a batch with chance DROP.
LEAST_STEPS, DROP = 200, 0.3
#: Texts of both classes that a language needs for a threshold of its own.
LEAST_TEXTS = 20
#: Steps of the scores among which a threshold is looked for.
BINS = 1 << 14

TEXTS = "bucket long, toxic binary, spare binary, langs array<string>, counts binary, words binary, n_words long, n_toxic long, n_clean long, n_spare_toxic long, n_spare_clean long"
CHANGES = "node long, slice int, sums binary, hits binary"


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of the embedding table for each word, and each text's first word."""
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, IS_BREAK)
    rolling = Rolling(data)
    whole = rolling.of(starts, ends)
    prefix = mix(rolling.of(starts, np.minimum(ends, starts + PREFIX)), 5)
    rows = np.stack([whole % np.uint64(ROWS), prefix % np.uint64(ROWS)], axis=1)
    return rows.astype(np.int32), first


class TextCNN:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.03, (ROWS, DIMENSIONS)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bends = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)
        self.squares = np.zeros((ROWS, 1), dtype=np.float32)

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.bends, self.out, self.bias]

    def state(self) -> np.ndarray:
        """All that training changes as rows: those of the table with their squares, then everything else."""
        rest = np.concatenate([p.ravel() for p in self.dense()])
        rest = np.pad(rest, (0, -len(rest) % (DIMENSIONS + 1))).reshape(-1, DIMENSIONS + 1)
        return np.concatenate([np.concatenate([self.table, self.squares], axis=1), rest])

    def load(self, state: np.ndarray) -> None:
        self.table, self.squares = state[:ROWS, :DIMENSIONS].copy(), state[:ROWS, DIMENSIONS:].copy()
        rest, at = state[ROWS:].ravel(), 0
        for p in self.dense():
            p[...] = rest[at : at + p.size].reshape(p.shape)
            at += p.size

    def projections(self) -> list[list[np.ndarray]]:
        """Table times filter, for each width and place in it: scoring only adds rows of these."""
        return [[self.table @ f[o] for o in range(len(f))] for f in self.filters]

    def pooled(self, projections: list[list[np.ndarray]], rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest value of each filter over each text; words behind the end are zero vectors."""
        counts = np.diff(first)
        out = np.zeros((len(counts), FILTERS * len(WIDTHS)), dtype=np.float32)
        some = np.flatnonzero(counts)
        if not len(some):
            return out
        left = np.repeat(first[1:], counts) - np.arange(len(rows))
        for k, (width, parts) in enumerate(zip(WIDTHS, projections, strict=True)):
            value = parts[0][rows[:, 0]] + parts[0][rows[:, 1]] + self.bends[k]
            for o in range(1, width):
                more = parts[o][rows[o:, 0]] + parts[o][rows[o:, 1]]
                value[: len(rows) - o] += more * (left[: len(rows) - o] > o)[:, None]
            out[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(value, first[some], axis=0), 0)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.bias[0]

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 12, weights: np.ndarray | None = None, least_steps: int = LEAST_STEPS) -> None:
        epochs = max(epochs, -(-least_steps * BATCH // max(1, len(texts))))
        rng = np.random.default_rng(seed)
        dense, squares = self.dense(), self.squares
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                index = order[k : k + BATCH]
                seen = [texts[i][rng.random(len(texts[i])) >= DROP] for i in index]
                grads, touched, pull = self._gradients(seen, labels[index], None if weights is None else weights[index])
                step += 1
                for p, g, (m, v) in zip(dense, grads, state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                # Rows of the table are touched rarely: Adagrad on those alone.
                rows, place = np.unique(touched, return_inverse=True)
                total = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
                np.add.at(total, place, pull)
                squares[rows] += (total * total).mean(axis=1, keepdims=True)
                self.table[rows] -= 0.1 * total / (np.sqrt(squares[rows]) + 1e-6)

    def _gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        counts = np.array([len(t) for t in texts])
        first = np.concatenate([[0], np.cumsum(counts)])
        rows = np.concatenate(texts)
        words = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        left = np.repeat(first[1:], counts) - np.arange(len(rows))
        pooled = np.zeros((len(texts), FILTERS * len(WIDTHS)), dtype=np.float32)
        peak = np.full(pooled.shape, -1, dtype=np.int64)
        for k, width in enumerate(WIDTHS):
            value = words @ self.filters[k][0] + self.bends[k]
            for o in range(1, width):
                value[: len(rows) - o] += (words[o:] @ self.filters[k][o]) * (left[: len(rows) - o] > o)[:, None]
            for t in np.flatnonzero(counts):
                block = value[first[t] : first[t + 1]]
                top = block.argmax(axis=0)
                best = block[top, np.arange(FILTERS)]
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                pooled[t, columns] = np.maximum(best, 0)
                peak[t, columns] = np.where(best > 0, top + first[t], -1)
        error = (1 / (1 + np.exp(-self.logits(pooled))) - labels).astype(np.float32) / len(texts)
        if weights is not None:
            error *= weights
        back = error[:, None] * self.out[None, :]
        filters, bends, touched, pull = [np.zeros_like(f) for f in self.filters], [np.zeros_like(b) for b in self.bends], [], []
        for k, width in enumerate(WIDTHS):
            t, c = np.nonzero(peak[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            at, g = peak[t, k * FILTERS + c], back[t, k * FILTERS + c]
            np.add.at(bends[k], c, g)
            for o in range(width):
                inside = left[at] > o
                place, column, pushed = at[inside] + o, c[inside], g[inside]
                np.add.at(filters[k][o].T, column, words[place] * pushed[:, None])
                each = self.filters[k][o].T[column] * pushed[:, None]
                for side in range(2):
                    touched.append(rows[place, side])
                    pull.append(each)
        return [*filters, *bends, pooled.T @ error, error.sum(keepdims=True)], np.concatenate(touched), np.concatenate(pull)


class Classifier:
    """A trained network with its projections, and thresholds by language."""

    def __init__(self, network: TextCNN | None, share: float, thresholds: dict[str, float]):
        self.network, self.share, self.thresholds = network, share, thresholds
        self.projections = network.projections() if network else []

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.share)
        return self.scores_of(*word_rows(data, offsets))

    def scores_of(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        logits = self.network.logits(self.network.pooled(self.projections, rows, first)).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Middle of the widest range of thresholds with the best F1, each text counted by its weight."""
    edges = np.unique(np.concatenate([[0.0], scores, [1.0]]))
    tried = (edges[1:] + edges[:-1]) / 2
    weights = weights.astype(np.float64)
    order = np.argsort(scores)
    at = np.searchsorted(scores[order], tried, side="left")
    # Weights of the texts from each place on, all and toxic ones.
    rest, right = (np.append(np.cumsum(w[order][::-1])[::-1], 0)[at] for w in (weights, weights * labels))
    f1 = 2 * right / np.maximum(1e-9, rest + (weights * labels).sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((edges[1:] - edges[:-1])[best])]
    return float(tried[k])


def _labelled(width: int):
    """Word rows of the labelled texts of a bucket, in the order of their ids; one in ``width`` is spare."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        ids, known = docs.column("doc_id").to_numpy(), marks.column("doc_id").to_numpy()
        by_id = np.argsort(known)
        at = np.searchsorted(known[by_id], ids)
        at[at == len(known)] = 0
        mine = np.flatnonzero(known[by_id][at] == ids) if len(known) else np.zeros(0, dtype=np.int64)
        mine = mine[np.argsort(ids[mine], kind="stable")]
        names = [x.split()[0] for x in TEXTS.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), *[pa.int64()] * 5]
        if not len(mine):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        toxic = marks.column("toxic").to_numpy()[by_id][at[mine]] > 0
        spare = mix(ids[mine].astype(np.uint64), 31) % np.uint64(width) == 0 if width else np.zeros(len(mine), dtype=bool)
        texts = docs.take(pa.array(mine))
        data, offsets = byte_view(texts.column("text"))
        words, counts = [], []
        for a, b in chunks(offsets):
            rows, first = word_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            words.append(rows.astype(np.uint16))
            counts.append(np.diff(first))
        words, counts = np.concatenate(words), np.concatenate(counts)
        values = [docs.column("bucket")[0].as_py(), toxic.tobytes(), spare.tobytes(), texts.column("lang").to_pylist(), counts.astype(np.int64).tobytes(), words.tobytes(), len(words)]
        values += [int(x.sum()) for x in (toxic & ~spare, ~toxic & ~spare, toxic & spare, ~toxic & spare)]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    return run


def _texts_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, each text's first word, labels and which are spare."""
    first = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], dtype=np.int64))])
    words = np.frombuffer(row["words"], dtype=np.uint16).reshape(-1, 2).astype(np.int32)
    return words, first, np.frombuffer(row["toxic"], dtype=bool), np.frombuffer(row["spare"], dtype=bool)


def _slices(node: int, sums: np.ndarray, hits: np.ndarray) -> pa.Table:
    starts = range(0, len(hits), SLICE)
    columns = [[node] * len(starts), list(range(len(starts))), [sums[k : k + SLICE].tobytes() for k in starts], [hits[k : k + SLICE].tobytes() for k in starts]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["node", "slice", "sums", "hits"])


def _train_part(shared, weights: tuple[float, float], round_: int):
    """Changes of the network by the texts of one part, times the number of these texts."""

    def run(table: pa.Table) -> pa.Table:
        network = copy.deepcopy(shared.value)
        node, texts, labels = table.column("node")[0].as_py(), [], []
        for row in sorted(table.to_pylist(), key=lambda r: r["bucket"]):
            words, first, toxic, spare = _texts_of(row)
            texts += [words[first[k] : first[k + 1]] for k in np.flatnonzero(~spare)]
            labels.append(toxic[~spare])
        y = np.concatenate(labels).astype(np.float32)
        before = network.state()
        if len(texts):
            weight = np.where(y > 0, np.float32(weights[1]), np.float32(weights[0]))
            network.train(texts, y, -(-EPOCHS // ROUNDS), 12 + round_, weight, -(-LEAST_STEPS // ROUNDS))
        after = network.state()
        hits = np.full(len(after), len(texts), dtype=np.float32)
        hits[:ROWS] *= after[:ROWS, DIMENSIONS] > before[:ROWS, DIMENSIONS]
        return _slices(node, (after - before) * hits[:, None], hits)

    return run


def _add(table: pa.Table) -> pa.Table:
    """Sum of the changes of one slice, in the order of their nodes."""
    rows = sorted(table.to_pylist(), key=lambda r: r["node"])
    sums = sum(np.frombuffer(r["sums"], dtype=np.float32) for r in rows)
    hits = sum(np.frombuffer(r["hits"], dtype=np.float32) for r in rows)
    return pa.table([pa.array([x], k) for x, k in zip([rows[0]["up"], rows[0]["slice"], sums.tobytes(), hits.tobytes()], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["node", "slice", "sums", "hits"])


def train_on_all(texts: DataFrame, parts: int, weights: tuple[float, float]) -> TextCNN:
    """Network trained by all parts of the texts (see :data:`TEXTS`) at once, averaged after each round."""
    network, context = TextCNN(), texts.sparkSession.sparkContext
    placed = texts.withColumn("node", F.pmod("bucket", F.lit(parts)))
    for round_ in range(ROUNDS):
        shared = context.broadcast(network)  # size fixed by ROWS, FILTERS and WIDTHS
        changes, nodes = placed.groupBy("node").applyInArrow(_train_part(shared, weights, round_), CHANGES), parts
        while True:
            changes, nodes = changes.withColumn("up", F.floor(F.col("node") / FAN)).groupBy("up", "slice").applyInArrow(_add, CHANGES), -(-nodes // FAN)
            if nodes == 1:
                break
        rows = changes.orderBy("slice").collect()  # one network
        state = network.state()
        hits = np.concatenate([np.frombuffer(r["hits"], dtype=np.float32) for r in rows])
        sums = np.concatenate([np.frombuffer(r["sums"], dtype=np.float32) for r in rows]).reshape(state.shape)
        network.load(state + sums / np.maximum(hits, 1)[:, None])
        shared.unpersist()
    return network


def language_thresholds(texts: DataFrame, network: TextCNN) -> dict[str, float]:
    """Best threshold of each language with enough spare texts, from the counts of all of these by score."""
    shared = texts.sparkSession.sparkContext.broadcast(Classifier(network, 0.0, {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, first, toxic, spare = _texts_of(row)
                place = np.rint(shared.value.scores_of(words, first) * BINS).astype(np.int32)
                langs = pa.array(row["langs"], pa.string()).filter(pa.array(spare))
                yield pa.RecordBatch.from_arrays([langs, pa.array(place[spare]), pa.array(toxic[spare])], ["lang", "place", "toxic"])

    scored = texts.select("langs", "counts", "words", "toxic", "spare").mapInArrow(run, "lang string, place int, toxic boolean").where("lang is not null")
    counted = scored.groupBy("lang", "place", "toxic").agg(F.count("*").alias("n"))
    enough = scored.groupBy("lang").agg(F.sum(F.col("toxic").cast("int")).alias("t"), F.count("*").alias("n")).where(f"t >= {LEAST_TEXTS} and n - t >= {LEAST_TEXTS}")
    found: dict[str, list] = {}
    for r in counted.join(enough.select("lang"), "lang", "left_semi").collect():  # 2 * (BINS + 1) rows a language at most
        found.setdefault(r["lang"], []).append((r["place"] / BINS, r["toxic"], r["n"]))
    return {lang: best_threshold(*(np.array(x, dtype=np.float64) for x in zip(*sorted(rows), strict=True))) for lang, rows in found.items()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, train_bytes: int | None = None, thresholds: bool = True) -> Classifier:
    """Classifier from all labelled ones of these documents (columns doc_id, text and, for thresholds, lang).

    Without ``thresholds`` no text is kept from training. ``train_docs`` or ``train_bytes`` bound the training; see :func:`fit_drawn`.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else [F.lit(None).cast("string").alias("lang")])).where("doc_id is not null")
    if train_docs is not None or train_bytes is not None:
        return fit_drawn(known, marks, train_docs, train_bytes)
    small_batches(docs.sparkSession)
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bucket_count(text_bytes(known)))).alias("bucket")
    left = known.select(bucket, F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").groupBy("bucket")
    right = marks.select(bucket, F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).groupBy("bucket")
    texts = cut(left.cogroup(right).applyInArrow(_labelled(CALIBRATION if thresholds else 0), TEXTS), "labelled")
    counted = ("n_words", "n_toxic", "n_clean", "n_spare_toxic", "n_spare_clean")
    words, *counts = (x or 0 for x in texts.agg(*(F.sum(c) for c in counted)).first())
    toxic, clean = counts[0] + counts[2], counts[1] + counts[3]
    if not toxic or not clean:
        return Classifier(None, float(toxic > 0), {})
    if not counts[0] or not counts[1]:
        # So few texts that all of a class are spare: nothing is left for thresholds.
        return fit_toxicity(docs, labels, thresholds=False)
    share = counts[0] / (counts[0] + counts[1])
    network = train_on_all(texts, bucket_count(words, PART_WORDS), (0.5 / (1 - share), 0.5 / share))
    network.bias += np.float32(np.log(toxic / clean))
    return Classifier(network, toxic / (toxic + clean), language_thresholds(texts, network) if thresholds else {})


def fit_drawn(known: DataFrame, marks: DataFrame, train_docs: int | None, train_bytes: int | None) -> Classifier:
    """Classifier from a bounded draw of the labelled texts, trained at the driver.

    Each class is drawn by the hash of its ids at a rate of its own, so that about ``train_docs`` texts and half of
    ``train_bytes`` bytes are expected of it; a class always has the text of its smallest hash.
    """
    # Labels without a document are gone before anything is drawn.
    sizes = known.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    marked = cut(sizes.join(marks, "doc_id").select("doc_id", "size", (F.col("toxic") > 0).alias("toxic"), place.alias("place")), "labelled")
    classes = marked.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min_by("doc_id", F.struct("place", "doc_id")).alias("first")).collect()
    counts = {int(r["toxic"]): r["n"] for r in classes}
    if len(counts) < 2:
        return Classifier(None, float(next(iter(counts), 0)), {})
    total = sum(counts.values())
    rates = {int(r["toxic"]): min(1.0, (train_docs or r["n"]) / r["n"], (train_bytes or 2 * r["bytes"]) / 2 / max(1, r["bytes"])) for r in classes}
    rate = F.when(F.col("toxic"), F.lit(rates[1])).otherwise(F.lit(rates[0]))
    chosen = marked.where((F.col("place") < rate * 1_000_000) | F.col("doc_id").isin([r["first"] for r in classes])).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    # What the caller allows, whatever the number of labels and of documents.
    rows = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "toxic").orderBy("doc_id").collect()
    data, offsets = byte_view(pa.array([r[1] for r in rows], pa.string()))
    texts, parts = [], list(chunks(offsets))
    for a, b in parts:
        embedded, first = word_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        texts += [embedded[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
    y = np.array([r[3] > 0 for r in rows], dtype=np.float32)
    calibration = np.arange(len(rows)) % CALIBRATION == 0
    network = TextCNN()
    train = np.flatnonzero(~calibration)
    network.train([texts[i] for i in train], y[train])
    drawn = max(1.0, float(y[train].sum())) / max(1.0, float((1 - y[train]).sum()))
    network.bias += np.float32(np.log(counts[1] / counts[0]) - np.log(drawn))
    classifier = Classifier(network, counts[1] / total, {})
    if calibration.any():
        # A class was drawn at its own rate; each text stands for as many labels as its class has for one that was drawn.
        weights = np.where(y > 0, counts[1] / max(1.0, float(y.sum())), counts[0] / max(1.0, float((1 - y).sum())))
        scores = np.concatenate([classifier.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in parts])
        for language in {r[2] for r in rows} - {None}:
            mine = calibration & np.array([r[2] == language for r in rows])
            if min(y[mine].sum(), (1 - y[mine]).sum()) >= LEAST_TEXTS:
                classifier.thresholds[language] = best_threshold(scores[mine], y[mine], weights[mine])
    return classifier


def toxicity_scores(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Score of each text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # size fixed by ROWS, FILTERS and WIDTHS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunked_texts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(data, offsets))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Documents under the threshold of their language (0.5 without one); all columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunked_texts(batches):
            limits = np.array([shared.value.thresholds.get(x, 0.5) for x in part.column(lang).to_pylist()])
            yield part.filter(pa.array(shared.value.scores(data, offsets) < limits))

    assert names.count("text") == 1 and text >= 0
    return docs.mapInArrow(run, docs.schema)


def toxicity_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from labels outside the held-out fold."""
    fold = remainder(FOLDS)
    classifier = fit_toxicity(docs.where(fold != HELD_OUT), labels, thresholds=False)
    return toxicity_scores(docs, classifier).select("doc_id", (fold == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
