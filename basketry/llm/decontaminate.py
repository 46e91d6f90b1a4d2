"""Benchmark decontamination by winnowing.

Texts are taken as lower-cased words of 0-9, a-z and non-ASCII characters. Of the hashes
of k consecutive words, the minimum of every w neighbours is kept as a fingerprint, on
both sides. With k + w - 1 = window, any span of `window` words that a document shares
with an item holds a common fingerprint. Documents' fingerprints are joined with the
items'; every hit is extended to the windows around it, and a window counts when all its
words are the item's. Items shorter than a window are one window each, found with k as
their own length and w = 1.

A benchmark of at most BLOCK_BYTES of text is sent to the workers whole, and documents are
read once and not shuffled. A larger one is never brought together anywhere: documents'
fingerprints are joined with the items' by a shuffle, and the windows around hits with the
items' windows by another; each of the two tables is in proportion to its input.

Null texts have no words; an item without words has no window. An item with a null id
counts as the item "". Rows that share an item id are one item; there are no other ties.
Repeated documents, documents that share an id and null ids get a result each, by their
texts alone. Empty tables: no documents, an empty result; no items, no hits. Documents of
any length are taken whole. Other columns, whatever their names, are left out, or kept as
they are by `decontaminated`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm._spark import Scratch, prepare, sized
from basketry.llm._text import ALNUM, grams, slices, utf8, words

BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Two hashes of a text, which tell it.
MARK = ("mark", "mark2")
_BITS = 20


class Lookup:
    """Positions of 64-bit values in a sorted table; most values that aren't in it are told by a bitmap."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.values & np.uint64((1 << _BITS) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of h that are in the table, and where they are there."""
        maybe = np.flatnonzero(self.bits[h & np.uint64((1 << _BITS) - 1)])
        at = np.searchsorted(self.values, h[maybe])
        at[at == len(self.values)] = 0
        hit = self.values[at] == h[maybe] if len(self.values) else np.zeros(0, bool)
        return maybe[hit], at[hit]


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Indexes of the values that are the minimum of some w neighbours (all, where there are fewer)."""
    n = len(g) - w + 1
    if n <= 0 or w == 1:
        return np.arange(len(g))
    low = g[:n].copy()
    for i in range(1, w):
        np.minimum(low, g[i : i + n], out=low)
    high = np.zeros(len(g), np.uint64)
    for i in range(w):
        np.maximum(high[i : i + n], low, out=high[i : i + n])
    return np.flatnonzero(high == g)


class Block:
    """The windows of some benchmark items and the fingerprints that lead to them, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, off = utf8(pa.array([t for _, t in items], pa.large_string()))
        names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(names)}
        prints, whole, owners = defaultdict(list), defaultdict(list), defaultdict(list)
        for lo, hi in slices(off):
            h, at, _, _ = words(data, off, lo, hi, ALNUM)
            for i in range(lo, hi):
                own = h[at[i - lo] : at[i - lo + 1]]
                if not len(own):
                    continue
                m, k = _length(len(own), window)
                g = grams(own, k)
                prints[m].append(g[winnow(g, m - k + 1)])
                whole[m].append(grams(own, m))
                owners[m].append(np.full(len(own) - m + 1, number[items[i][0]]))
        self.names = names
        self.by_length = {}
        for m in prints:
            values, owner = np.concatenate(whole[m]), np.concatenate(owners[m])
            table = Lookup(values)
            at = np.searchsorted(table.values, values)
            order = np.argsort(at, kind="stable")
            begin = np.searchsorted(at[order], np.arange(len(table.values) + 1))
            _, k = _length(m, window)
            self.by_length[m] = (k, Lookup(np.concatenate(prints[m])), table, owner[order], begin)

    def spans(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of the windows among words h of the rows that begin at `at`, with the numbers of their items' owner lists."""
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        starts, lengths, found = [], [], []
        for m, (k, prints, table, _, _) in self.by_length.items():
            g = grams(h, k)
            keep = winnow(g, m - k + 1)
            hit = keep[prints.find(g[keep])[0]]
            s = np.unique((hit[:, None] - np.arange(m - k + 1)).ravel())
            s = s[(s >= 0) & (s + m <= len(h))]
            s = s[doc[s] == doc[s + m - 1]] if len(s) else s
            if len(s):
                which, place = table.find(grams(h[s[:, None] + np.arange(m)].ravel(), m)[::m])
                starts.append(s[which])
                lengths.append(np.full(len(which), m))
                found.append(place)
        if not starts:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)


def _merged(spans: np.ndarray) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for s, e in spans.tolist():
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def _length(n: int, window: int) -> tuple[int, int]:
    """Of an item of n words: the length of its windows, and of the runs of words whose hashes are winnowed."""
    m = min(window, n)
    return m, -(-window // 2) if m == window else m


def _small(benchmark: DataFrame, window: int, item_column: str, text_column: str) -> Block | None:
    """The benchmark as one block, if it isn't larger than that."""
    chosen = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    return Block([(r["item"], r["text"]) for r in chosen.collect()], window) if size <= BLOCK_BYTES else None


def _marks(text_column: str) -> list:
    return [F.xxhash64(text_column).alias("mark"), F.xxhash64(F.lit(77), text_column).alias("mark2")]


def _hashes(rows: DataFrame, keys: list[str], schema: str, emit) -> DataFrame:
    """Of rows (keys, text): what emit makes of a slice's word hashes and where each row's begin: arrays, the first of them rows of the slice."""
    fields = pa.schema([(n, pa.int64()) for n in schema.split()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(len(keys)))
            for lo, hi in slices(off):
                h, at, _, _ = words(data, off, lo, hi, ALNUM)
                more = batch.slice(lo, hi - lo)
                for row, *columns in emit(h, at, more):
                    own = [more.column(k).take(pa.array(row)) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns)], names=[*keys, *fields.names])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"{k} {types[k]}" for k in keys] + [f"{n} long" for n in fields.names]))


def _windows(h: np.ndarray, at: np.ndarray, window: int):
    """Of items' words: (row, m, k) of each row, its windows' hashes and its fingerprints."""
    for r in range(len(at) - 1):
        own = h[at[r] : at[r + 1]]
        if len(own):
            m, k = _length(len(own), window)
            g = grams(own, k)
            yield r, m, k, grams(own, m), g[winnow(g, m - k + 1)]


def _found(documents: DataFrame, benchmark: DataFrame, window: int, text_column: str, item_column: str, item_text_column: str, scratch: Scratch) -> DataFrame:
    """Of each different text with a window of the benchmark: mark, mark2, items, n_hit, spans; by shuffles alone."""
    items = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_column), F.lit("")).alias("text"))

    def of_items(which: int):
        def emit(h, at, _):
            for r, m, k, *found in _windows(h, at, window):
                x = found[which]
                yield np.full(len(x), r), np.full(len(x), m), np.full(len(x), k), x

        return emit

    theirs = scratch.save(_hashes(items, ["item"], "m k hash", of_items(0)).select("item", "m", "hash").distinct(), "windows")
    prints = scratch.save(_hashes(items, ["item"], "m k hash", of_items(1)).select("m", "k", "hash").distinct(), "prints")
    lengths = sorted((r["m"], r["k"]) for r in prints.select("m", "k").distinct().collect())  # as many as a window has words at most

    def of_documents(h, at, _):
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for m, k in lengths:
            g = grams(h, k)
            keep = winnow(g, m - k + 1)
            if len(keep):
                yield row[keep], np.full(len(keep), m), keep - at[row[keep]], g[keep]

    texts = documents.select(*_marks(text_column), F.col(text_column).alias("text"))
    hits = _hashes(texts, [*MARK], "m at hash", of_documents).join(prints.select("m", "hash"), ["m", "hash"], "left_semi")
    hits = scratch.save(hits.select(*MARK, F.struct("m", "at").alias("hit")).distinct().groupBy(*MARK).agg(F.collect_list("hit").alias("hits")), "hits")
    again = texts.join(sized(hits, 20_000), [*MARK]).dropDuplicates([*MARK]).select(*MARK, "text", "hits")

    def around(h, at, more):
        k_of = dict(lengths)
        for r, hits in enumerate(more.column(3).to_pylist()):
            own = h[at[r] : at[r + 1]]
            for m in {x["m"] for x in hits}:
                places = np.array([x["at"] for x in hits if x["m"] == m])
                s = np.unique((places[:, None] - np.arange(m - k_of[m] + 1)).ravel())
                s = s[(s >= 0) & (s + m <= len(own))]
                if len(s):
                    yield np.full(len(s), r), np.full(len(s), m), s, grams(own[s[:, None] + np.arange(m)].ravel(), m)[::m]

    spans = _hashes(again, [*MARK], "m start hash", around).join(theirs, ["m", "hash"])
    spans = scratch.save(spans.select(*MARK, "item", "start", (F.col("start") + F.col("m")).alias("end")), "spans")
    named = spans.select(*MARK, "item").distinct().groupBy(*MARK).agg(F.array_sort(F.collect_list("item")).alias("items"))
    before = Window.partitionBy(*MARK).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    merged = spans.select(*MARK, "start", "end").distinct().withColumn("begins", F.coalesce((F.col("start") > F.max("end").over(before)), F.lit(True)).cast("int"))
    merged = merged.withColumn("n", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*MARK, "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    merged = merged.groupBy(*MARK).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return scratch.save(named.join(merged, [*MARK]), "found")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window), items (ids as strings, sorted), spans (of hit words, first to behind the last)."""
    spark = prepare(documents.sparkSession)
    block = _small(benchmark, window, item_column, item_text_column)
    if block is None:
        found = _found(documents, benchmark, window, text_column, item_column, item_text_column, Scratch(spark))
        counted = _hashes(
            documents.select(F.col(id_column).cast("long").alias("doc_id"), *_marks(text_column), F.col(text_column).alias("text")), ["doc_id", *MARK], "n_words", lambda h, at, _: [(np.arange(len(at) - 1), np.diff(at))]
        )
        joined = counted.join(found, [*MARK], "left")
        none = {"items": "array<string>", "spans": "array<struct<start:bigint,end:bigint>>"}
        return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()))
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in slices(off):
                h, at, _, _ = words(data, off, lo, hi, ALNUM)
                start, length, place = block.spans(h, at)
                row = np.searchsorted(at, start, "right") - 1
                order = np.lexsort((start, row))
                start, length, place, row = (x[order] for x in (start, length, place, row))
                items: list[list[str]] = [[] for _ in range(hi - lo)]
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                for r in np.unique(row).tolist():
                    s, n, p = (x[ends[r] : ends[r + 1]] for x in (start, length, place))
                    spans[r] = _merged(np.stack([s - at[r], s - at[r] + n], 1))
                    names = set()
                    for m in np.unique(n).tolist():
                        _, _, _, owner, begin = block.by_length[m]
                        for x in np.unique(p[n == m]).tolist():
                            names.update(owner[begin[x] : begin[x + 1]].tolist())
                    items[r] = sorted(block.names[x] for x in names)
                hit = [sum(x["end"] - x["start"] for x in ss) for ss in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPAN)],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    spark = prepare(documents.sparkSession)
    block = _small(benchmark, window, item_column, item_text_column)
    if block is None:
        found = _found(documents, benchmark, window, text_column, item_column, item_text_column, Scratch(spark)).select(*(F.col(c).alias(f"__{c}") for c in MARK))
        one, two = _marks(text_column)
        return documents.join(sized(found), (one == F.col("__mark")) & (two == F.col("__mark2")), "left_anti")
    sent = spark.sparkContext.broadcast(block)
    position = documents.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(position))
            clean = np.ones(batch.num_rows, bool)
            for lo, hi in slices(off):
                h, at, _, _ = words(data, off, lo, hi, ALNUM)
                start, _, _ = sent.value.spans(h, at)
                clean[lo + np.searchsorted(at, start, "right") - 1] = False
            yield batch.filter(pa.array(clean))

    return documents.mapInArrow(run, documents.schema)
