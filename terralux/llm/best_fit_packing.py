"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents are encoded once, each followed by a separator id, and cut into pieces only where they
are longer than a sequence. The plan never sees documents: best-fit decreasing runs over the
count of each length (at most ``size`` different ones) and yields slots as ranges of equal
bins. Each piece has a rank among the pieces of its length, from its rank within its task and the
sum over the tasks before it, and takes the slot of that rank. No group of pieces meets in one
task, however many share a length.

A null or empty text is the separator alone. A repeated row is a document of its own. An empty table
gives an empty result. Ties between equal lengths go by the order of the input's partitions.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralux.llm.common import IS_SPACE, byte_view, chunks, cut, free_memory, small_batches

SIZE = 2048
SEPARATOR = 0
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Encoded strings that a worker remembers.
REMEMBERED = 1_200_000

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local_rank long"


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, remembered per string between white space.

    This tokenizer drops white space and never joins what white space separates, so the ids of
    a text are those of its strings in a row. Unknown strings are encoded together, kept
    apart by a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = sorted(self._tokenizer.get_added_tokens_decoder().items())
        self._mark_id, self._mark = (self._special[-1][0], self._special[-1][1].content) if self._special else (None, None)
        self._known: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self._known) > REMEMBERED:
            self._known.clear()
        new = list(set().union(*texts).difference(self._known))
        plain = [w for w in new if b"<|" not in w] if self._mark else []
        for k in range(0, len(plain), 500):
            block = plain[k : k + 500]
            ids = np.array(self._tokenizer.encode(self._mark.join(w.decode() for w in block), add_special_tokens=False).ids, dtype="<u4")
            edges = np.flatnonzero(ids == self._mark_id)
            lows, highs = [0, *(edges + 1).tolist()], [*edges.tolist(), len(ids)]
            self._known.update((w, ids[a:b].tobytes()) for w, a, b in zip(block, lows, highs, strict=True))
        for w in new:
            if w not in self._known:
                self._known[w] = self._encode(w.decode())

    def forget(self) -> None:
        self._known.clear()

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self._known.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, keep: bool = True) -> WordEncoder:
    """The worker's encoder, or a new one whose memory goes with the partition that uses it."""
    if not keep:
        return WordEncoder(path)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_SPACES = bytes(np.flatnonzero(IS_SPACE).tolist())


def _split(text: bytes) -> list[bytes]:
    # A special token is found in the text as it stands; lower-casing first must not make one,
    # and beyond ASCII it could change which characters compose.
    return (text.lower() if text.isascii() and b"<|" not in text else text).split()


def encoded_pieces(docs: DataFrame, size: int = SIZE, separator: int = SEPARATOR, tokenizer: str = TOKENIZER, keep: bool = True) -> DataFrame:
    """One row per piece with its checksum, the task that made it and its rank among that task's pieces of equal length."""
    small_batches(docs.sparkSession)
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, keep), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            raw, rows = data.tobytes(), []
            for a, b in chunks(offsets):
                words = [_split(raw[offsets[k] : offsets[k + 1]]) for k in range(a, b)]
                encode.learn(words)
                for doc_id, text in zip(batch.column(0).slice(a, b - a).to_pylist(), words, strict=True):
                    ids = encode.ids(text) + end
                    for piece in range(-(-len(ids) // (4 * size))):
                        cut_out = ids[4 * size * piece : 4 * size * (piece + 1)]
                        n = len(cut_out) // 4
                        rows.append((doc_id, piece, size * piece, n, zlib.crc32(cut_out), part, int(seen[n])))
                        seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if not keep:
            encode.forget()
            free_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Plan:
    """Best-fit decreasing over counts of lengths.

    A slot range says: pieces of this length, from this rank on, go ``per_bin`` to a bin into
    consecutive bins from ``bin`` on, behind ``offset``. Filling the tightest open bin until no
    further piece of the length fits is what best fit does piece by piece.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.bins = 0
        room: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def put(free: int, first: int, n: int) -> None:
            if free and n:
                if free not in room:
                    room[free] = []
                    bisect.insort(rooms, free)
                room[free].append((first, n))

        for length in sorted(counts, reverse=True):
            left, rank = counts[length], 0
            while left:
                k = bisect.bisect_left(rooms, length)
                if k == len(rooms):
                    n = -(-left // (size // length))
                    put(size, self.bins, n)
                    self.bins += n
                    continue
                free = rooms[k]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], rooms[k]
                fit = free // length
                whole = min(n, left // fit)
                used, each = (whole, fit) if whole else (1, left)
                self.rows.append((length, rank, first, each, size - free))
                put(free - each * length, first, used)
                put(free, first + used, n - used)
                rank += used * each
                left -= used * each

    def placer(self) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 5)
        base = 1 << 44
        keys = rows[:, 0] * base + rows[:, 1]

        def place(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row = rows[np.searchsorted(keys, length * base + rank, side="right") - 1]
            nth = rank - row[:, 1]
            return row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length

        return place


def pack(docs: DataFrame, size: int = SIZE, separator: int = SEPARATOR, tokenizer: str = TOKENIZER, keep: bool = True) -> DataFrame:
    """Pieces with their sequence and offset. Workers ``keep`` encoded strings from one partition to the next, unless other stages follow."""
    pieces = cut(encoded_pieces(docs, size, separator, tokenizer, keep), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # At most `size` rows, whatever the number of documents.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = Plan(histogram, size).placer()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            bin_, offset = place(length.astype(np.int64), rank)
            kept = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bin_), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(shifts, ["part", "length"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("shift") + F.col("local_rank")).alias("rank")
    )
    return ranked.mapInArrow(take, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
