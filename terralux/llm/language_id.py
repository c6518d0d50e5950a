"""Language identification by unigram pieces with the segmentation marginalised out.

The vocabulary is fixed: the pieces of a public tokenizer that consist of letters, lower-cased.
Each language has its own piece probabilities. The probability of a word is the sum over all its
segmentations into pieces, by a forward algorithm; probabilities are learned by
expectation-maximisation over the same segmentations (forward-backward). A text's score is the
posterior of its likeliest language, from all its words and the languages' shares of documents.

Words are runs of letters, lower-cased; everything else is not read. Words over ``MAX_BYTES``
bytes are read in parts. A character outside the vocabulary counts as one unknown piece.

Piece probabilities are fitted on at most about ``TRAIN_DOCS`` documents a language, chosen by a
hash of their ids; shares of languages come from all documents with a language, and every text is
scored whole. Workers remember the scores of words; their memory is bounded by
``REMEMBERED`` words.

Null text, or text without a letter: ``und`` with score 0. A null language teaches nothing; without
any language everything is ``und``. Repeated rows are scored one by one; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralux.llm.common import LOWER, Rolling, chunked_texts, remainder, small_batches, spans

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
FOLDS, HELD_OUT = 4, 2
TRAIN_DOCS = 1_500
EM_ROUNDS = 4
SMOOTHING = 0.05
MAX_BYTES = 32
REMEMBERED = 400_000
UNKNOWN = "und"

#: Separates words: ASCII but letters. What is beyond ASCII is looked at word by word.
_NO_LETTER = np.zeros(256, dtype=bool)
_NO_LETTER[0:0x41] = _NO_LETTER[0x5B:0x61] = _NO_LETTER[0x7B:0x80] = True
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Stands before each word, as the vocabulary's mark does.
_FRONT = b"\x01"


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Different pieces of letters, lower-cased; index 0 stands for an unknown character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, None] = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k).lower()
        body = piece.removeprefix("▁")
        if body.isalpha() or (not body and piece):
            pieces[(_FRONT if piece != body else b"") + body.encode()] = None
    return [b"", *pieces]


class Lattice:
    """Which pieces lie where in a batch of words of similar length."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], words: list[bytes]):
        sizes = np.array([len(w) + 1 for w in words])
        self.width = int(sizes.max())
        flat = np.frombuffer(b"".join((_FRONT + w).ljust(self.width, b"\0") for w in words), dtype=np.uint8)
        self.sizes, self.count = sizes, len(words)
        bytes_ = flat.reshape(self.count, self.width)
        rolling = Rolling(flat)
        row = np.arange(self.count) * self.width
        begins_char = (bytes_ & 0xC0) != 0x80
        #: (start, end, rows, piece) in order of the end.
        self.arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for end in range(1, self.width + 1):
            for size in range(1, min(end, len(tables) - 1) + 1):
                hashes, index = tables[size]
                rows = np.flatnonzero(sizes >= end)
                if len(hashes) and len(rows):
                    got = rolling.of(row[rows] + end - size, row[rows] + end)
                    at = np.searchsorted(hashes, got)
                    at[at == len(hashes)] = 0
                    hit = hashes[at] == got
                    if hit.any():
                        self.arcs.append((end - size, end, rows[hit], index[at[hit]]))
            # A character that is no piece of its own is an unknown piece.
            for size in range(1, min(end, 4) + 1):
                start = end - size
                one_char = begins_char[:, start] & (sizes >= end) & ~begins_char[:, start + 1 : end].any(axis=1)
                if end < self.width:
                    one_char &= begins_char[:, end] | (sizes == end)
                rows = np.flatnonzero(one_char)
                if len(rows):
                    hashes, _ = tables[size] if size < len(tables) else (np.zeros(0, dtype=np.uint64), None)
                    got = rolling.of(row[rows] + start, row[rows] + end)
                    unknown = rows[~np.isin(got, hashes)]
                    if len(unknown):
                        self.arcs.append((start, end, unknown, np.zeros(len(unknown), dtype=np.int64)))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of each prefix: words x places x languages. p: pieces x languages."""
        out = np.zeros((self.count, self.width + 1, p.shape[1]))
        out[:, 0] = 1
        for start, end, rows, piece in self.arcs:
            out[rows, end] += out[rows, start] * p[piece]
        return out

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in these words of one language, by forward-backward."""
        ahead = self.forward(p[:, None])[:, :, 0]
        behind = np.zeros_like(ahead)
        behind[np.arange(self.count), self.sizes] = 1
        total = ahead[np.arange(self.count), self.sizes]
        uses = np.zeros(len(p))
        for start, end, rows, piece in reversed(self.arcs):
            through = behind[rows, end] * p[piece]
            behind[rows, start] += through
            uses += np.bincount(piece, ahead[rows, start] * through * counts[rows] / total[rows], len(p))
        return uses


def piece_tables(pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length in bytes: sorted hashes and their pieces."""
    tables = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)) for _ in range(max(map(len, pieces)) + 1)]
    by_size: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces[1:], 1):
        by_size.setdefault(len(piece), []).append(k)
    for size, index in by_size.items():
        flat = np.frombuffer(b"".join(pieces[k] for k in index), dtype=np.uint8)
        starts = np.arange(len(index)) * size
        hashes = Rolling(flat).of(starts, starts + size)
        order = np.argsort(hashes)
        tables[size] = hashes[order], np.array(index)[order]
    return tables


def lattices(tables: list[tuple[np.ndarray, np.ndarray]], words: list[bytes], batch: int = 20_000) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Words by length, in batches: their indices and lattice."""
    order = np.argsort([len(w) for w in words], kind="stable")
    for k in range(0, len(order), batch):
        index = order[k : k + batch]
        yield index, Lattice(tables, [words[i] for i in index])


def word_parts(word: bytes) -> list[bytes]:
    """Runs of letters of a string without ASCII separators, lower-cased and of bounded length."""
    if word.isascii():
        runs = [word.lower()]
    else:
        runs = [m.lower().encode() for m in _LETTERS.findall(word.decode())]
    out = []
    for run in runs:
        while len(run) > MAX_BYTES:
            at = MAX_BYTES
            while at > 1 and run[at] & 0xC0 == 0x80:
                at -= 1
            out.append(run[:at])
            run = run[at:]
        out.append(run)
    return out


class Model:
    """Piece probabilities (pieces x languages) over a vocabulary; languages and their shares."""

    def __init__(self, pieces: list[bytes], languages: list[str], probability: np.ndarray, share: np.ndarray):
        self.pieces, self.languages, self.probability, self.share = pieces, languages, probability, share

    @classmethod
    def fit(cls, words: dict[str, dict[bytes, int]], shares: dict[str, float], pieces: list[bytes], rounds: int = EM_ROUNDS) -> Model:
        tables, languages = piece_tables(pieces), sorted(shares)
        columns = []
        for language in languages:
            known = words.get(language) or {}
            parts: dict[bytes, int] = {}
            for word, n in known.items():
                for part in word_parts(word):
                    parts[part] = parts.get(part, 0) + n
            # Start from pieces that are rarer the longer they are.
            p = np.array([1e-6, *(64.0 ** -len(x) + 1e-6 for x in pieces[1:])])
            p /= p.sum()
            strings = list(parts)
            counts = np.array([parts[s] for s in strings], dtype=np.float64)
            batches = [(counts[i], lattice) for i, lattice in lattices(tables, strings)] if strings else []
            for _ in range(rounds):
                uses = SMOOTHING + sum((lattice.expected(p, n) for n, lattice in batches), np.zeros(len(p)))
                p = uses / uses.sum()
            columns.append(p)
        share = np.array([shares[x] for x in languages])
        return cls(pieces, languages, np.stack(columns, axis=1) if columns else np.zeros((len(pieces), 0)), share / max(share.sum(), 1e-300))


class Scorer:
    """Log probabilities of words in all languages, remembered by the hash of the word."""

    def __init__(self, model: Model):
        self.model, self.tables = model, piece_tables(model.pieces)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.values = np.zeros((1024, len(self.model.languages) + 1), dtype=np.float64)

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        parts = [word_parts(w) for w in words]
        strings = list({p for x in parts for p in x})
        number = {s: k for k, s in enumerate(strings)}
        value = np.zeros((len(strings), len(self.model.languages)))
        for index, lattice in lattices(self.tables, strings) if strings else ():
            ahead = lattice.forward(self.model.probability)
            value[index] = np.log(np.maximum(ahead[np.arange(lattice.count), lattice.sizes], 1e-300))
        n = len(self.place)
        while len(self.values) < n + len(words):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        counts = np.array([len(x) for x in parts])
        flat = np.array([number[p] for x in parts for p in x], dtype=np.int64)
        owner = np.repeat(np.arange(n, n + len(words)), counts)
        self.values[n : n + len(words)] = 0
        np.add.at(self.values[:, :-1], owner, value[flat])
        self.values[n : n + len(words), -1] = counts > 0
        self.place.update(zip(hashes, range(n, n + len(words)), strict=True))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log probabilities by text, and whether a text has a letter."""
        starts, ends, first = spans(data, offsets, _NO_LETTER)
        n = len(offsets) - 1
        if not len(starts):
            return np.zeros((n, len(self.model.languages))), np.zeros(n, dtype=bool)
        lowered = LOWER[data]
        hashes, place, uses = np.unique(Rolling(lowered).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > REMEMBERED:
            self._clear()
        listed = hashes.tolist()
        new = [k for k, h in enumerate(listed) if h not in self.place]
        if new:
            self._learn([listed[k] for k in new], [lowered[starts[place[k]] : ends[place[k]]].tobytes() for k in new])
        rows = self.values[np.fromiter(map(self.place.__getitem__, listed), np.int64, len(listed))]
        sums = np.zeros((n, rows.shape[1]))
        some = np.flatnonzero(np.diff(first))
        sums[some] = np.add.reduceat(rows[uses], first[some], axis=0)
        return sums[:, :-1], sums[:, -1] > 0


_scorers: dict[str, Scorer] = {}


def training_words(docs: DataFrame) -> DataFrame:
    """(language, word, n) of these documents; counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunked_texts(batches):
            counts: dict[tuple[str, bytes], int] = {}
            languages, raw = part.column(1).to_pylist(), LOWER[data]
            starts, ends, first = spans(raw, offsets, _NO_LETTER)
            raw = raw.tobytes()
            for k, language in enumerate(languages):
                for a, b in zip(starts[first[k] : first[k + 1]].tolist(), ends[first[k] : first[k + 1]].tolist(), strict=True):
                    key = language, raw[a:b]
                    counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    return docs.select("text", "lang").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> Model:
    """Model from documents with text and language; at most about ``train_docs`` a language are read for the pieces."""
    labelled = docs.where("text is not null and lang is not null")
    shares = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.count("*")).collect()}
    words: dict[str, dict[bytes, int]] = {}
    if shares:
        part = F.create_map(*(x for k, n in shares.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / n)))))
        chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000
        for lang, word, n in training_words(labelled.where(chosen)).toLocalIterator():
            words.setdefault(lang, {})[bytes(word)] = n
    return Model.fit(words, shares, read_pieces(vocabulary))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language and posterior of each text."""
    small_batches(docs.sparkSession)
    key = f"{id(model)}-{hash(model.probability.tobytes())}"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed vocabulary by the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        scorer = _scorers[key]
        languages = scorer.model.languages
        for part, data, offsets in chunked_texts(batches):
            sums, letters = scorer.texts(data, offsets)
            if languages:
                logs = sums + np.log(scorer.model.share)
                best = logs.argmax(axis=1)
                score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, score, letters = np.zeros(len(sums), dtype=int), np.zeros(len(sums)), np.zeros(len(sums), dtype=bool)
            predicted = [languages[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(predicted, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold."""
    model = fit_languages(docs.where(remainder(FOLDS) != HELD_OUT))
    return identify(docs, model).select("doc_id", (remainder(FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
