"""N-gram Jaccard join by PartEnum signatures, and the groups its links form.

A document's set holds its different word shingles. Sets are put in size bands so that two sets of
Jaccard similarity ``PERCENT`` / 100 or more share a band: that of the larger one, which the smaller one
also enters if it can have partners there. Within a band two such sets differ in at most k
elements. The element domain is dealt to m > k partitions; at least m - k of them agree in full. A
set's signatures are the hashes of its elements in each partition that is not empty: N of them, so
that of any partner's signatures at least N - k are its own too.

Subsets of partitions are enumerated by frequency: of its N signatures a set needs only the k + 1
rarest, as the rarest common one is among those of both sets. A passage or line that many
documents share thus makes no candidates unless little else is in the documents. Sets with N <= k
(small ones whose elements fall together) keep all signatures, and meet each other by single
elements instead.

Sets that are equal are one class and take part once. Of a signature's classes, all pairs are
candidates where there are at most ``SMALL_GROUP`` of them. For the classes of larger groups it is
counted first how many shingles no other of them has. Those shingles cannot be common, which
bounds the similarity of any pair from above; classes that cannot reach the threshold with any other leave,
again and again. For this and the hubs, groups led by the same class (that of the least hash) count as one, as near copies share many
signatures. In what is left, ``ROUNDS`` times, every class of a group that is not connected yet is
held against a hub, the one with the fewest shingles of its own (the text that others were edited from), the second time the
one that is not connected to the first;
then the pairs of a signature that are still in different components follow, those that the bound and the differences from both hubs allow. So no link between
different texts is missed for the components. Candidates are tested exactly, on the shingles' 64-bit hashes.

A signature is sent by five bytes and its bucket; two that cannot be told apart make a candidate more, never one less.

Null text or no words: an empty set, linked with nothing. Fewer words than a shingle: the whole
sequence is one shingle. Null ids: no link, null component. Rows with equal ids must be equal rows and give one
result row each. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralux.llm.common import (
    IS_SPACE,
    LOWER,
    Rolling,
    bucket_count,
    bucket_of,
    chunked_texts,
    cut,
    dealt,
    free_memory,
    from_varint,
    group_ranks,
    mix,
    small_batches,
    spans,
    text_bytes,
    to_varint,
)

SHINGLE = 5
PERCENT = 80
SMALL_GROUP = 12
#: Signatures by which pairs of classes that share several are met once.
LEAST_SIGNATURES = 16
#: Times that open groups are held against one of their classes, and that classes without partners leave before.
ROUNDS, PRUNINGS = 2, 2
#: Partitions of a band per difference that its sets may have.
PARTITIONS_PER_DIFFERENCE = 1.35
#: Signatures that are sent together.
BLOCK_SIGNATURES = 1_500_000
#: Bytes of a signature that are sent to its bucket.
SENT_BYTES = 5
#: Bytes of sets that a part of the exact tests receives on average, at most.
PART_BYTES = 64_000_000

DIGEST = "doc_id long, n_shingles long, class long"
SIGNED = "bucket long, classes binary, bands binary, drops binary, counts binary, signatures binary"
REPEATED = "part long, classes binary, drops binary, signatures binary, frequencies binary"
KEPT = "bucket long, classes binary, signatures binary"
CANDIDATES = "kind string, a long, b long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text, ordered, and each text's first one."""
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, IS_SPACE)
    words = Rolling(data).of(starts, ends)
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(first[:-1], n) + group_ranks(n)
    size = np.repeat(np.minimum(counts, width), n)
    hashes = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        inside = size > k
        hashes[inside] = mix(hashes[inside] * np.uint64(0xD6E8FEB86659FD93) + words[at[inside] + k], 7)
    doc = np.repeat(np.arange(len(counts)), n)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(counts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each range of ``values`` modulo 2**64; 0 for empty ranges."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[first[1:]] - sums[first[:-1]]


def set_classes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each set as a whole."""
    return mix(_sums(mix(hashes, 11), first) + np.diff(first).astype(np.uint64), 12).view(np.int64)


def size_bands(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Largest set size of each band, up to one that takes ``largest`` and its partners."""
    ends, low = [], 1
    while not ends or ends[-1] * percent < largest * 100:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return np.array(ends)


def most_differences(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Elements in which sets of these sizes can differ at most.

    With j = percent / 100 the intersection holds at least j / (1 + j) of both sizes' sum.
    """
    return (a + b) * (100 - percent) // (100 + percent)


def signatures(hashes: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, signatures to drop, signature) for each set in each of its bands."""
    sizes = np.diff(first)
    if not len(sizes) or not sizes.max():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    ends = size_bands(int(sizes.max()), percent)
    own = np.searchsorted(ends, sizes)
    out = []
    for step in (0, 1):
        band = own + step
        reach = sizes * 100 // percent
        partner = np.minimum(reach, ends[np.minimum(band, len(ends) - 1)])
        enters = (sizes > 0) & (band < len(ends)) & (partner > (ends[np.maximum(band - 1, 0)] if step else 0))
        k = most_differences(sizes, partner, percent)
        # Where no difference is allowed, only equal sets are similar; they are one class already.
        enters &= k > 0
        m = np.ceil(PARTITIONS_PER_DIFFERENCE * (most_differences(ends, ends, percent) + 1)).astype(np.int64) + 1
        sets = np.flatnonzero(enters)
        if not len(sets):
            continue
        n = sizes[sets]
        at = np.repeat(first[sets], n) + group_ranks(n)
        owner = np.repeat(np.arange(len(sets)), n)
        m_of = m[band[sets]]
        salted = mix(hashes[at], 21)
        base = np.cumsum(m_of) - m_of
        cell = base[owner] + (salted % m_of[owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, values = cell[order], mix(salted[order], 22)
        head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        content = _sums(values, np.append(head, len(cell)))
        cell = cell[head]
        of = np.searchsorted(base, cell, side="right") - 1
        place = (cell - base[of]).astype(np.uint64)
        name = mix(band[sets][of].astype(np.uint64) * np.uint64(1 << 40) + place, 23)
        filled = np.bincount(of, minlength=len(sets))
        spare = filled - k[sets]
        out.append((sets[of], np.maximum(spare - 1, 0)[of], mix(content ^ name, 24)))
        odd = np.flatnonzero(spare <= 0)
        if len(odd):
            n = sizes[sets[odd]]
            at = np.repeat(first[sets[odd]], n) + group_ranks(n)
            name = mix(np.repeat(band[sets[odd]], n).astype(np.uint64), 25)
            out.append((np.repeat(sets[odd], n), np.zeros(int(n.sum()), dtype=np.int64), mix(hashes[at] ^ name, 26)))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def digests(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Per document: size and class of its set; an empty set has no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunked_texts(batches):
            hashes, first = shingle_sets(data, offsets, width)
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(set_classes(hashes, first), mask=n == 0)], ["doc_id", "n_shingles", "class"])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def sent_form(signs: np.ndarray, n_buckets: int) -> np.ndarray:
    """What a bucket knows a signature by: its highest bytes, and the bucket."""
    return (signs >> np.uint64(64 - 8 * SENT_BYTES) << np.uint64(64 - 8 * SENT_BYTES)) | bucket_of(signs, n_buckets).astype(np.uint64)


def one_of_each(classes: np.ndarray, drops: np.ndarray, signs: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different signatures of each class and number of drops, ordered by these.

    Two signatures of a set and band that a bucket could not tell apart count as one, and the set and band may
    drop one less for it, so that a common one stays. That depends on the set alone, so all its copies say the same.
    """
    order = np.lexsort((signs, drops, classes))
    classes, drops, signs = classes[order], drops[order], signs[order]
    head = np.ones(len(signs), dtype=bool)
    head[1:] = (classes[1:] != classes[:-1]) | (drops[1:] != drops[:-1])
    new = head.copy()
    new[1:] |= signs[1:] != signs[:-1]
    classes, drops, signs, head = classes[new], drops[new], signs[new], head[new]
    group = np.cumsum(head) - 1
    sent = sent_form(signs, n_buckets)
    shift = np.uint64(64 - 8 * SENT_BYTES)
    again = np.zeros(len(signs), dtype=bool)
    # Signatures of the same highest bytes are neighbours; few are.
    close = ~head[1:] & (signs[1:] >> shift == signs[:-1] >> shift)
    if close.any():
        order = np.lexsort((sent, group))
        again[order[1:]] = (sent[order[1:]] == sent[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        fewer = np.bincount(group[again], minlength=int(head.sum()))
        drops = np.maximum(drops - fewer[group], 0)
    return classes[~again], drops[~again], signs[~again]


def _sign(n_buckets: int, width: int, percent: int):
    """Signatures of the different sets of a block of documents, dealt to buckets.

    In a row, a class is named once with its number of runs (what one of its bands has in the bucket); a run has its drops
    and its number of signatures, of which the bucket leaves ``SENT_BYTES`` bytes to be told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            classes, drops, signs = (np.concatenate(x) for x in zip(*held, strict=True))
            classes, drops, signs = one_of_each(classes, drops, signs, n_buckets)
            # Big-endian bytes, the highest first.
            sent = signs.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES]
            rows = []
            for b, i in dealt(signs, n_buckets):
                c, d = classes[i], drops[i]
                head = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])]))
                counts, d, c = np.diff(np.append(head, len(i))), d[head], c[head]
                named = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                rows.append((b, c[named].tobytes(), to_varint(np.diff(np.append(named, len(c)))), to_varint(d), to_varint(counts), sent[i].tobytes()))
            return _batch(SIGNED, rows)

        for _, data, offsets in chunked_texts(batches):
            hashes, first = shingle_sets(data, offsets, width)
            classes = set_classes(hashes, first)
            # Equal sets of a chunk are signed once.
            _, once = np.unique(classes, return_index=True)
            n = np.diff(first)[once]
            hashes = hashes[np.repeat(first[once], n) + group_ranks(n)]
            owner, drops, signs = signatures(hashes, np.concatenate([[0], np.cumsum(n)]), percent)
            held.append((classes[once][owner], drops, signs))
            size += len(signs)
            if size >= BLOCK_SIGNATURES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        held = []
        free_memory()

    return run


def _repeated(n_parts: int):
    """Of a bucket's signatures: those of several classes, with their number of classes, back to the classes' parts."""

    def run(table: pa.Table) -> pa.Table:
        bucket = np.uint64(table.column("bucket")[0].as_py())
        rows = table.drop_columns("bucket").to_pylist()
        counts = [from_varint(r["counts"]) for r in rows]
        raw = np.concatenate([np.frombuffer(r["signatures"], dtype=np.uint8) for r in rows]).reshape(-1, SENT_BYTES)
        # As sent_form has them.
        signs = np.zeros(len(raw), dtype=np.uint64)
        for k in range(SENT_BYTES):
            signs |= raw[:, k].astype(np.uint64) << np.uint64(56 - 8 * k)
        signs |= bucket
        classes = np.concatenate([np.repeat(np.repeat(np.frombuffer(r["classes"], dtype=np.int64), from_varint(r["bands"])), n) for r, n in zip(rows, counts, strict=True)])
        drops = np.concatenate([np.repeat(from_varint(r["drops"]), n) for r, n in zip(rows, counts, strict=True)])
        order = np.argsort(signs)
        tie = np.zeros(len(signs), dtype=bool)
        tie[1:] = signs[order][1:] == signs[order][:-1]
        tie[:-1] |= tie[1:]
        chosen = order[tie]
        signs, classes, drops = signs[chosen], classes[chosen], drops[chosen]
        order = np.lexsort((drops, classes, signs))
        signs, classes, drops = signs[order], classes[order], drops[order]
        new = np.ones(len(signs), dtype=bool)
        new[1:] = (signs[1:] != signs[:-1]) | (classes[1:] != classes[:-1])
        signs, classes, drops = signs[new], classes[new], drops[new]
        _, group, n = np.unique(signs, return_inverse=True, return_counts=True)
        several = n[group] > 1
        signs, classes, drops, n = signs[several], classes[several], drops[several], n[group][several]
        return pa.Table.from_batches(
            [_batch(REPEATED, [(p, classes[i].tobytes(), to_varint(drops[i]), signs[i].tobytes(), to_varint(n[i])) for p, i in dealt(classes.view(np.uint64), n_parts)])]
        )

    return run


def _rarest(n_buckets: int):
    """Of the classes of a part: drops the most frequent signatures as far as each set and band may."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        classes = np.concatenate([np.frombuffer(r["classes"], dtype=np.int64) for r in rows])
        signs = np.concatenate([np.frombuffer(r["signatures"], dtype=np.uint64) for r in rows])
        drops, n = (np.concatenate([from_varint(r[c]) for r in rows]) for c in ("drops", "frequencies"))
        # A set's bands are told apart by what they may drop. Where that is equal they are read as one
        # list, of which no more is dropped than either may lose.
        order = np.lexsort((signs, -n, drops, classes))
        classes, signs, drops = classes[order], signs[order], drops[order]
        head = np.concatenate([[True], (classes[1:] != classes[:-1]) | (drops[1:] != drops[:-1])])
        sizes = np.diff(np.append(np.flatnonzero(head), len(head)))
        keep = group_ranks(sizes) >= drops
        classes, signs = classes[keep], signs[keep]
        return pa.Table.from_batches([_batch(KEPT, [(b, classes[i].tobytes(), signs[i].tobytes()) for b, i in dealt(signs, n_buckets)])])

    return run


def _candidates(table: pa.Table) -> pa.Table:
    """Pairs of small groups; of larger ones the members."""
    rows = table.to_pylist()
    classes = np.concatenate([np.frombuffer(r["classes"], dtype=np.int64) for r in rows])
    signs = np.concatenate([np.frombuffer(r["signatures"], dtype=np.uint64) for r in rows])
    order = np.lexsort((classes, signs))
    classes, signs = classes[order], signs[order]
    first = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]]))
    sizes = np.diff(np.append(first, len(signs)))
    pairs = [np.zeros((2, 0), dtype=np.int64)]
    for step in range(1, SMALL_GROUP):
        # Members `step` places apart in groups that are small.
        n = np.where(sizes <= SMALL_GROUP, np.maximum(sizes - step, 0), 0)
        left = np.repeat(first, n) + group_ranks(n)
        pairs.append(np.stack([classes[left], classes[left + step]]))
    large = sizes > SMALL_GROUP
    found = np.unique(np.concatenate(pairs, axis=1), axis=1) if len(signs) else pairs[0]
    members = np.repeat(first[large], sizes[large]) + group_ranks(sizes[large])
    kind = np.concatenate([np.full(found.shape[1], "pair"), np.full(len(members), "member")])
    a = np.concatenate([found[0], signs[members].view(np.int64)])
    b = np.concatenate([found[1], classes[members]])
    return pa.table([pa.array(kind, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def candidate_classes(docs: DataFrame, n: int, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(kind, a, b): candidate pairs of classes, and (signature, class) of large groups."""
    signed = docs.select("text").mapInArrow(_sign(n, width, percent), SIGNED)
    repeated = signed.groupBy("bucket").applyInArrow(_repeated(n), REPEATED)
    kept = repeated.groupBy("part").applyInArrow(_rarest(n), KEPT)
    return kept.groupBy("bucket").applyInArrow(_candidates, CANDIDATES)


def dealt_by(one: str, other: str, size: str):
    """Key by which a pair is dealt: one of its classes, whose pairs are split further where its size allows many partners.

    Whatever groups are like, a class has no more signatures than some share of its size, and so many small
    groups or hubs; a partner's set is at most 100 / ``PERCENT`` times its own (8 bytes an element).
    """
    splits = F.ceil(F.lit(10.0 * (SMALL_GROUP - 1)) * F.col(size) * F.col(size) / F.lit(PART_BYTES))
    return F.xxhash64(F.col(one), F.pmod(F.xxhash64(other), splits))


def placed_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs with their part; there are so many parts that ``PART_BYTES`` hold what a part's pairs name."""
    elements = pairs.agg(F.sum("size")).first()[0] or 0
    # A pair's sets hold at most 2.25 times the elements of the one whose size is given.
    n = max(n, bucket_count(18 * elements, PART_BYTES))
    return pairs.select("a", "b", F.pmod("deal", F.lit(n)).alias("part"))


def linked_pairs(pairs: DataFrame, sets: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """(a, b, both, linked) of the pairs (a, b, deal, size) of classes that are similar, by their sets (class, hashes).

    ``both`` is the size of the intersection. Pairs with a column ``measure`` are all returned, also those that are not ``linked``.
    A pair is tested in a part that its key ``deal`` tells; a part gets each set that its pairs name once. The key must not
    gather the pairs of a class that can have any number of partners. ``size`` is that of one of the two sets.
    """
    measure = "measure" in pairs.columns
    placed = placed_pairs(pairs, n)
    wanted = placed.select(F.col("a").alias("class"), "part").union(placed.select(F.col("b").alias("class"), "part")).distinct()
    sent = wanted.join(sets, "class").select((F.col("part") + 0).alias("to"), "class", "hashes")

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {c: np.frombuffer(h.as_buffer(), dtype=np.uint64) for c, h in zip(right.column("class").to_pylist(), right.column("hashes"), strict=True)}
        out = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            x, y = known[a], known[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            linked = 100 * both >= percent * (len(x) + len(y) - both)
            if linked or measure:
                out.append((a, b, both, linked))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["a", "b", "both", "linked"])

    return placed.groupBy("part").cogroup(sent.groupBy("to")).applyInArrow(test, "a long, b long, both long, linked boolean")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(class, component): smallest class reachable over links (a, b), by alternating star contractions.

    ``known`` are labels (class, component) that hold already; they count as links.
    """
    edges = links.select("a", "b")
    if known is not None:
        edges = edges.union(known.where("class != component").select(F.col("component").alias("a"), F.col("class").alias("b")))
    edges = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u != v").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        # Large star: larger neighbours of a node go to its smallest neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select("m", "v").where("m != v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(low, "v").select("least", F.col("m").alias("w")).where("least != w").union(low.select("least", F.col("v").alias("w")))
        edges = cut(small.select(F.col("least").alias("u"), F.col("w").alias("v")).distinct(), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("v").alias("class"), F.col("u").alias("component"))


def own_shingles(sets: DataFrame, n: int) -> DataFrame:
    """(class, size, own): shingles of each set, and at least how many of them are in no other set.

    Shingles are told apart by 32 bits within a bucket; one that collides counts as common.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(h.as_buffer(), dtype=np.uint64) for h in batch.column(1)]
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) for x in parts])
            hashes = np.concatenate(parts)
            rows = []
            for b, i in dealt(hashes, n):
                c = owner[i]
                head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                rows.append((b, c[head].tobytes(), to_varint(np.diff(np.append(head, len(c)))), (hashes[i] >> np.uint64(32)).astype(np.uint32).tobytes()))
            yield _batch("bucket long, classes binary, counts binary, keys binary", rows)

    def alone(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint32) for r in rows])
        owner = np.concatenate([np.repeat(np.frombuffer(r["classes"], dtype=np.int64), from_varint(r["counts"])) for r in rows])
        _, place, uses = np.unique(keys, return_inverse=True, return_counts=True)
        classes, n_own = np.unique(owner[uses[place] == 1], return_counts=True)
        return pa.table({"class": classes, "own": n_own})

    dealt_out = sets.select("class", "hashes").mapInArrow(deal, "bucket long, classes binary, counts binary, keys binary")
    own = dealt_out.groupBy("bucket").applyInArrow(alone, "class long, own long").groupBy("class").agg(F.sum("own").alias("own"))
    return sets.select("class", "size").join(own, "class", "left").select("class", "size", F.coalesce("own", F.lit(0)).alias("own"))


def _may_link(a: str, b: str, percent: int):
    """Whether two sets could be similar if all but their own shingles were common."""
    return F.expr(f"100 * least({a}.size - {a}.own, {b}.size - {b}.own) >= {percent} * ({a}.size + {b}.size - least({a}.size - {a}.own, {b}.size - {b}.own))")


def _near_hub(k: int, percent: int):
    """Whether classes l and r could be similar by how they differ from their group's hub of round ``k``.

    A set lacks ``lacks`` shingles of the hub's and has ``adds`` others, of which ``alone`` are in no other set. Two sets differ
    at least by the difference of what they lack and by what they add and cannot share.
    """
    differ = (
        f"abs(l.lacks{k} - r.lacks{k}) + l.adds{k} + r.adds{k} - 2 * least(l.adds{k} - l.alone{k}, r.adds{k} - r.alone{k})"
    )
    return F.expr(f"({differ}) * {100 + percent} <= (l.size + r.size) * {100 - percent}")


def _reachable(open_: DataFrame, percent: int) -> DataFrame:
    """Members that may link across components, and whether they are outside the first hub's component (``outer``).

    Of any such pair one class is outside. Let two sets differ in no more than they may: then the first one's ``far``, by how much
    it is too far from the hub, is no more than the ``reach`` of the second, whatever the two have in common.
    """
    far = (F.col("lacks0") + F.col("adds0")) * (100 + percent) - (F.col("size") + F.col("hub_size0")) * (100 - percent)
    reach = (F.col("lacks0") + F.col("adds0") - 2 * F.col("alone0")) * (100 + percent) + (F.col("adds0") - F.col("lacks0")) * (100 - percent)
    told = open_.withColumns({"far": far, "reach": reach, "outer": F.col("component") != F.col("hub_component0")})
    most = told.groupBy("lead").agg(F.max("reach").alias("most"))
    told = told.join(most, "lead").where("far <= most")
    least = told.where("outer").groupBy("lead").agg(F.min("far").alias("nearest"))
    return told.join(least, "lead").where("outer or reach >= nearest").drop("far", "reach", "most", "nearest")


def gathered(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(signature, class, lead) of the groups with several components.

    The lead of a group is its class of the least hash, so groups of much the same classes mostly have the same one. Groups with
    the same lead are held against hubs together: a class of near copies is then in a few rows, not in one per signature.
    """
    placed = members.join(labels, "class", "left").select("signature", "class", F.coalesce("component", "class").alias("component"))
    told = placed.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min_by("class", F.xxhash64("class")).alias("lead"))
    return members.select("signature", "class").join(told.where("x != y").select("signature", "lead"), "signature")


def connect_large_groups(members: DataFrame, tested: DataFrame, labels: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Labels after all links between classes that share a signature of a large group."""
    tested = tested.select("a", "b")
    told: list[str] = []
    members = cut(gathered(members, labels), "members")
    rows = members.select("lead", "class").distinct()

    for round_ in range(ROUNDS + 1):
        labelled = rows.join(labels, "class", "left").select("lead", "class", *told, F.coalesce("component", "class").alias("component"))
        if round_:
            # Where the first hub belongs by now.
            at = labels.select(F.col("class").alias("hub0"), F.col("component").alias("at"))
            labelled = labelled.join(at, "hub0", "left").withColumn("hub_component0", F.coalesce("at", "hub0")).drop("at")
        labelled = cut(labelled, "labelled")
        several = labelled.groupBy("lead").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
        open_ = cut(labelled.join(several.select("lead"), "lead", "left_semi"), "open")
        if not open_.limit(1).count():
            return labels
        fit = open_
        for _ in range(PRUNINGS):
            own = cut(own_shingles(sets.join(fit.select("class").distinct(), "class", "left_semi"), n), "own")
            # Even a partner that lies within the set must hold enough of it.
            fit = own.where(100 * (F.col("size") - F.col("own")) >= percent * F.col("size"))
        open_ = cut(open_.join(fit, "class"), "open")
        if round_ < ROUNDS:
            # Of classes with the same part of own shingles the largest; the next hub is outside the first one's component.
            best = F.struct((F.col("own") / F.col("size")).alias("part"), (-F.col("size")).alias("less"), "class", "size")
            outside = F.when(F.col("component") != F.col("hub_component0"), best) if round_ else best
            hub = open_.groupBy("lead").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(outside).alias("hub"))
            met = open_.alias("m").join(hub.where("x != y").drop("x", "y"), "lead")
            met = met.withColumns({"a": F.least("m.class", "hub.class"), "b": F.greatest("m.class", "hub.class")})
            # By the class that is not the hub: the hub's set goes to every part, its partners each to theirs.
            pairs = met.where("a != b").select("a", "b", dealt_by("m.class", "hub.class", "m.size").alias("deal"), "m.size")
            pairs = cut(pairs.dropDuplicates(["a", "b"]).withColumn("measure", F.lit(True)), "pairs")
            measured = cut(linked_pairs(pairs, sets, n, percent), "measured")
            links = measured.where("linked").select("a", "b")
            both, itself = F.coalesce("both", "size"), F.col("a") == F.col("b")
            view = {
                f"hub{round_}": F.col("hub.class"), f"hub_size{round_}": F.col("hub.size"), f"lacks{round_}": F.col("hub.size") - both,
                f"adds{round_}": F.col("size") - both, f"alone{round_}": F.when(itself, F.lit(0)).otherwise(F.col("own")),
            }
            seen = met.join(measured.select("a", "b", "both"), ["a", "b"], "left")
            rows = seen.select("lead", "class", *told, *(c.alias(x) for x, c in view.items()))
            told += view
        else:
            # The pairs themselves are of one signature again.
            open_ = cut(_reachable(open_, percent).join(members, ["lead", "class"]), "open")
            # Classes that share several signatures meet at the first: each row knows the least of its class.
            least = open_.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("signature")), 1, LEAST_SIGNATURES).alias("least"))
            listed = cut(open_.join(least, "class"), "open")
            left, right = listed.where("outer").alias("l"), listed.alias("r")
            across = F.expr("l.signature = r.signature and l.component != r.component and (not r.outer or l.class < r.class)")
            for k in range(ROUNDS):
                across &= _near_hub(k, percent)
            met_before = F.expr("exists(array_intersect(l.least, r.least), x -> x < l.signature)")
            # By both classes, as either may have any number of partners.
            deal = F.xxhash64(F.least("l.class", "r.class"), F.greatest("l.class", "r.class"))
            pairs = left.join(right, across & _may_link("l", "r", percent) & ~met_before).select(
                F.least("l.class", "r.class").alias("a"), F.greatest("l.class", "r.class").alias("b"), deal.alias("deal"), "l.size"
            )
            pairs = cut(pairs.dropDuplicates(["a", "b"]).join(tested, ["a", "b"], "left_anti"), "pairs")
            links = linked_pairs(pairs, sets, n, percent)
        labels = components(links, labels)
        tested = tested.unionByName(pairs.select("a", "b"))
    return labels


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: n_shingles, class, and component_id, the smallest doc_id reachable over links."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = bucket_count(text_bytes(docs))
    known = docs.where("doc_id is not null")
    digest = cut(digests(docs, width), "digests")
    classes = cut(digest.where("doc_id is not null and class is not null").groupBy("class").agg(F.min("doc_id").alias("first_id")), "classes")
    found = cut(candidate_classes(known, n, width, percent), "candidates")
    pairs = cut(found.where("kind = 'pair'").select("a", "b").distinct(), "pairs")
    members = found.where("kind = 'member'").select(F.col("a").alias("signature"), F.col("b").alias("class"))

    named = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).union(members.select("class")).distinct()
    readers = named.join(classes, "class").select(F.col("first_id").alias("doc_id"), "class")
    sets = cut(_sets(known, readers, width), "sets")
    sized = pairs.join(sets.select(F.col("class").alias("b"), "size"), "b").select("a", "b", dealt_by("b", "a", "size").alias("deal"), "size")
    labels = components(linked_pairs(sized, sets, n, percent))
    labels = connect_large_groups(members, pairs, labels, sets, n, percent)
    grouped = classes.join(labels, "class", "left").select("class", F.coalesce("component", "class").alias("component"), "first_id")
    ids = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = grouped.join(ids, "component").select("class", "component_id")
    out = digest.join(by_class, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "class")


def _sets(docs: DataFrame, readers: DataFrame, width: int) -> DataFrame:
    """(class, size, hashes) of the first documents of these classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunked_texts(batches):
            hashes, first = shingle_sets(data, offsets, width)
            sets = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("class")), pa.array(np.diff(first)), pa.array(sets, pa.binary())], ["class", "size", "hashes"])

    return docs.join(readers.hint("merge"), "doc_id").select("class", "text").mapInArrow(run, "class long, size long, hashes binary")


def keep_one(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one of the smallest id; all columns stay."""
    found = near_duplicates(docs, width, percent)
    later = found.where("component_id < doc_id").select(F.col("doc_id").alias("_later_id")).distinct()
    return docs.join(later.hint("merge"), docs["doc_id"] == later["_later_id"], "left_anti")
