"""Lines that many documents share, kept in one of them.

Every text is read twice to find what comes again. First each task puts the hashes of its
documents' lines into two Bloom filters: those seen once, and those that met a line there
already. The filters of all tasks are merged part by part: what one task has seen once and
another too is seen twice. Then, with the merged second filter, only lines that it knows
are suspected; their digests alone are shuffled, with the document's id, and counted
exactly. A line that a filter takes for another costs a row of this shuffle and changes
nothing in the result.

Filters have four bits for every line that could fit into the texts, in a power of two, and
most_bits at most: no more than that is ever sent to a task. Texts of far more than 20 GB
for each 2**29 bits fill them up; then more and more single lines are suspected, until at
the worst each line's digest is shuffled, summed up by each task before. Give more bits
where executors have the memory.

Few digests can be frequent: the list of those with more than a thousandth of a percent of
all suspected lines is short by its own condition and broadcast; the others are joined by
a shuffle, in which none has many rows. Documents meet the numbers of their lost lines by
id and a hash of the text.

A line's key is the line without white space at both ends and with A-Z lower-cased. Each row
is a document, a repeated one too. Shared lines stay in all rows with the largest id that
holds them (a null id is less than all others; if all are null, they stay in all). A null
or empty text is one empty line. Texts and lines of any length are taken whole. Other
columns, whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._spark import BATCH_BYTES, Scratch, prepare
from basketry.llm._text import NOT_SPACE, SLICE, U, hashes, slices, utf8

#: Bits of a filter at most (64 MB), and of the parts in which filters are merged.
MOST_BITS, PART_BITS = 1 << 29, 1 << 20
#: Digests with more than one in so many of all suspected lines are joined by broadcast.
FREQUENT = 100_000
_SUSPECTS = "doc_id long, text_hash long, digest binary, lines array<int>"
_NEWLINE = 10
_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lines_of(seg: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line with a key: its row, its number in the row, and its key's first and end bytes. starts: where each row's bytes begin, and the end."""
    breaks, rows = np.flatnonzero(seg == _NEWLINE), np.arange(len(starts) - 1)
    before = np.searchsorted(breaks, starts)
    # Every row has a line more than breaks, so this is where its lines begin among all.
    lead = rows + before[:-1]
    k = np.searchsorted(starts, breaks, "right") - 1 + np.arange(len(breaks))
    begin, end = np.empty((2, len(rows) + len(breaks)), np.int64)
    begin[lead], begin[k + 1] = starts[:-1], breaks + 1
    end[rows + before[1:]], end[k] = starts[1:], breaks
    owner = np.repeat(rows, np.diff(before) + 1)
    number = np.arange(len(owner)) - lead[owner]
    solid = np.flatnonzero(NOT_SPACE[seg])
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    some = b > a
    return owner[some], number[some], solid[a[some]], solid[b[some] - 1] + 1


def keys_of(data: np.ndarray, off: np.ndarray, lo: int, hi: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows lo to hi, lines whose keys have at least so many code points: row, number, the key's first and end bytes from the row lo's first, and hash. A key beyond a slice is hashed by itself, others together."""
    base = int(off[lo])
    seg = data[base : off[hi]]
    row, number, first, end = lines_of(seg, off[lo : hi + 1] - base)
    long = end - first >= least
    row, number, first, end = row[long], number[long], first[long], end[long]
    h, chars, i = np.empty(len(row), np.uint64), np.empty(len(row), np.int64), 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(end, first[i] + SLICE, "right")))
        a, b = int(first[i]), int(end[j - 1])
        if b - a > SLICE:
            h[i] = int.from_bytes(hashlib.blake2b(seg[a:b].tobytes().translate(_ASCII_LOWER), digest_size=8).digest(), "little")
            chars[i] = int(((seg[a:b] & 0xC0) != 0x80).sum())
        else:
            h[i:j] = hashes(seg[a:b], first[i:j] - a, end[i:j] - a)
            count = np.concatenate([[0], np.cumsum((seg[a:b] & 0xC0) != 0x80)])
            chars[i:j] = count[end[i:j] - a] - count[first[i:j] - a]
        i = j
    enough = chars >= least
    return row[enough], number[enough], first[enough], end[enough], h[enough]


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The two places of each hash in a filter."""
    return np.stack([h & U(bits - 1), (h >> U(32)) & U(bits - 1)]).astype(np.int64)


def knows(bloom: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def mark(bloom: np.ndarray, at: np.ndarray) -> None:
    at = at.reshape(-1)
    np.bitwise_or.at(bloom, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def meet(once: np.ndarray, twice: np.ndarray, row: np.ndarray, h: np.ndarray) -> None:
    """Put the lines of some documents into both filters."""
    order = np.lexsort((row, h))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, n = np.unique(h[new], return_counts=True)
    at = places(h, len(once) * 8)
    mark(twice, at[:, knows(once, at) | (n > 1)])
    mark(once, at)


def line_duplicates(documents: DataFrame, least_length: int = 20, least_documents: int = 3, most_bits: int = MOST_BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (of the lines that stay). Keys of at least that length that so many documents hold lose their lines but in the document with the largest id."""
    spark = prepare(documents.sparkSession)
    scratch = Scratch(spark)
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(PART_BITS, 1 << (4 * size // (least_length + 1)).bit_length()))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            data, off = utf8(batch.column(0))
            for lo, hi in slices(off):
                row, _, _, _, h = keys_of(data, off, lo, hi, least_length)
                meet(once, twice, row, h)
        for part, lo in enumerate(range(0, bits // 8, PART_BITS // 8)):
            if once[lo : lo + PART_BITS // 8].any():
                yield _filters(part, *(zlib.compress(x[lo : lo + PART_BITS // 8], 1) for x in (once, twice)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, both = None, np.zeros((2, PART_BITS // 8), np.uint8)
        for batch in batches:
            for part, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if now is not None:
                        yield _filters(now, b"", zlib.compress(both[1], 1))
                    now, both = part, np.zeros((2, PART_BITS // 8), np.uint8)
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in packed)
                both[1] |= twice | (both[0] & once)
                both[0] |= once
        if now is not None:
            yield _filters(now, b"", zlib.compress(both[1], 1))

    schema = "part int, once binary, twice binary"
    filters = docs.select("text").mapInArrow(seen, schema).repartition("part").sortWithinPartitions("part").mapInArrow(merged, schema)
    # Not more than most_bits, whatever the input.
    parts = scratch.save(filters, "filters").select("part", "twice").collect()
    second = spark.sparkContext.broadcast({r["part"]: bytes(r["twice"]) for r in parts})

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.zeros(bits // 8, np.uint8)
        for part, packed in second.value.items():
            twice[part * PART_BITS // 8 : (part + 1) * PART_BITS // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in slices(off):
                row, number, first, end, h = keys_of(data, off, lo, hi, least_length)
                known = knows(twice, places(h, bits))
                found: dict[tuple[int, bytes], list[int]] = {}
                for r, n, a, b in zip(row[known].tolist(), number[known].tolist(), (first[known] + off[lo]).tolist(), (end[known] + off[lo]).tolist()):
                    found.setdefault((r + lo, hashlib.sha256(data[a:b].tobytes().translate(_ASCII_LOWER)).digest()), []).append(n)
                at = pa.array([r for r, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([d for _, d in found], pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32()))], names=["doc_id", "text_hash", "digest", "lines"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    suspects = scratch.save(hashed.mapInArrow(suspected, _SUSPECTS), "suspects")
    second.unpersist()
    shared = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("stays")).where(F.col("n") >= least_documents)
    shared = scratch.save(shared, "shared")
    frequent = F.col("n") > suspects.count() // FREQUENT
    lost = suspects.join(F.broadcast(shared.where(frequent)), "digest").unionByName(suspects.join(shared.where(~frequent), "digest"))
    lost = lost.where(~F.col("doc_id").eqNullSafe(F.col("stays"))).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("lines")).alias("lost"))
    lost = scratch.save(lost.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}), "lost")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            size = 0
            for doc, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.count("\n") + 1
                if gone:
                    drop = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                for column, x in zip(rows, (doc, lines, len(gone or ()), text)):
                    column.append(x)
                size += len(text)
                if size > BATCH_BYTES:
                    yield _kept(rows)
                    rows, size = [[], [], [], []], 0
            yield _kept(rows)

    joined = hashed.join(lost, hashed["doc_id"].eqNullSafe(lost["d"]) & (hashed["text_hash"] == lost["t"]), "left").select("doc_id", "text", "lost")
    scratch.drop("filters", "suspects", "shared")
    return joined.mapInArrow(kept, "doc_id long, n_lines long, n_dropped long, text string")


def _filters(part: int, once: bytes, twice: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], names=["part", "once", "twice"])


def _kept(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_lines", "n_dropped", "text"])
