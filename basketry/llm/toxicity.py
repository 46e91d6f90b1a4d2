"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores every sentence by its words, their
beginnings and the beginnings that come again in it, each once; a document's score is the noisy-or of its sentences' scores, one minus
the product of their complements. Only documents have labels: the gradient of the
document's likelihood is shared out among its sentences, so the model learns which of them
offend, and the sentence with the highest score is reported with its place.

Training takes a bounded sample of labelled documents, on the driver: POSITIVES and
NEGATIVES bound their number (the first by a hash of the id) and BYTES their texts (short
ones first, each whole). Features are chosen by how much more often documents labelled 1
hold them; FEATURES bounds the model that is sent out. Positive documents weigh WEIGHT times
as much as others. That weight and PREFIXES were chosen by cross-validation within rows that
aren't held out. Scoring covers every document whole, in one pass without a shuffle.

Null and empty texts have no sentences and the score 0. Null labels and labels of unknown
documents are left out; of several labels of one id the highest holds, and of several texts
of a labelled id one is learned from. Without a positive label every score is near 0.
Repeated rows are scored each; null ids too. Of sentences that tie for the highest score
the first is reported. Very long texts are scored whole. No documents: an empty result.
Other columns, with whatever names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm._spark import prepare
from basketry.llm._text import ALNUM, slices, utf8, words

POSITIVES, NEGATIVES, FEATURES = 1500, 3000, 4000
#: Association (chi-square) from which a feature is used.
LEAST_CHI2 = 24.0
#: Bytes of the sample's texts.
BYTES = 64 << 20
#: Characters of words' beginnings; those of the first two numbers count again when they come again in a sentence.
PREFIXES = (4, 5, 6, 7)
WEIGHT = 5.0
_AGAIN = np.uint64(0x5555)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def held_out(column: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    """Feature hashes in order, their weights, and the bias of a sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self.features & np.uint64((1 << 18) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of h that are features, and which."""
        maybe = np.flatnonzero(self.bits[h & np.uint64((1 << 18) - 1)])
        if not len(self.features):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.features, h[maybe]), len(self.features) - 1)
        hit = self.features[at] == h[maybe]
        return maybe[hit], at[hit]


def _sentences(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Of the words of rows lo to hi: where each row's begin, the number of each word's sentence, (words, hashes) of the features, first and end bytes."""
    h, at, first, end, *more = words(data, off, lo, hi, ALNUM, prefixes=PREFIXES)
    seg = data[off[lo] : off[hi]]
    stops = np.cumsum(_STOP[seg]) if len(seg) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(hi - lo), np.diff(at))
    mark = stops[first] + row if len(first) else np.zeros(0, np.int64)
    number = np.cumsum(np.diff(mark, prepend=mark[:1]) != 0) if len(mark) else mark
    again = []
    for which, value in more[:2]:
        order = np.lexsort((which, value, number[which]))
        a, b = order[:-1], order[1:]
        which, value = ((x[b])[(number[which[a]] == number[which[b]]) & (value[a] == value[b])] for x in (which, value))
        again.append((which, value ^ _AGAIN))
    return at, number, [(np.arange(len(h)), h), *more, *again], first, end


def fit(documents: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", positives: int = POSITIVES, negatives: int = NEGATIVES, steps: int = 500) -> Model:
    """A model of the labels given; hold rows out before."""
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max((F.col(label_column) > 0).cast("int")).alias("y"))
    known = known.cache()
    order = (F.xxhash64("id"), "id")
    ids = known.where("y = 1").orderBy(*order).limit(positives).unionByName(known.where("y = 0").orderBy(*order).limit(negatives))
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = documents.select(F.col(id_column).alias("id"), text.alias("text"), F.octet_length(text).alias("bytes"))
    # One row of each id, the one whose text has the least hash; then whole texts, short ones first, up to BYTES.
    found = texts.join(F.broadcast(ids), "id").select("id", "y", "bytes", F.struct(F.xxhash64("text").alias("hash"), "text").alias("row"))
    found = found.groupBy("id", "y").agg(F.min(F.struct("row.hash", "bytes")).alias("first"))
    kept, total = [], 0
    for r in sorted(found.select("id", "y", "first.hash", "first.bytes").collect(), key=lambda r: (r["bytes"], r["hash"])):
        if (total := total + r["bytes"]) > BYTES:
            break
        kept.append((r["id"], r["y"], r["hash"]))
    known.unpersist()
    if not any(y for _, y, _ in kept) or all(y for _, y, _ in kept):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    chosen = documents.sparkSession.createDataFrame(kept, found.select("id", "y", F.col("first.hash").alias("hash")).schema)
    sample = texts.join(F.broadcast(chosen), "id").where(F.xxhash64("text") == F.col("hash")).dropDuplicates(["id"]).select("id", "y", "text").toArrow()
    sample = sample.sort_by([("id", "ascending")])
    return learn(np.array(sample.column("y").to_pylist(), np.int64), sample.column("text"), steps)


def learn(y: np.ndarray, texts: pa.ChunkedArray | pa.Array, steps: int = 500) -> Model:
    """A model of texts and their labels, some of either."""
    data, off = utf8(texts)

    def documents_of(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """Of chosen rows: the row, its feature hashes, their sentences, and how many sentences it has. Nothing is kept."""
        for i in rows.tolist():
            at, number, features, _, _ = _sentences(data, off, i, i + 1)
            h, word = np.concatenate([x[1] for x in features]), np.concatenate([x[0] for x in features])
            yield i, h, number[word] if len(h) else word, int(number[-1]) + 1 if len(number) else 0

    # One of each text counts for the choice of features, lest copies stand for evidence. A feature comes from a positive document.
    _, once = np.unique([hash(data[off[i] : off[i + 1]].tobytes()) for i in range(len(y))], return_index=True)
    value, a = np.unique(np.concatenate([np.unique(h) for _, h, _, _ in documents_of(once[y[once] == 1])]), return_counts=True)
    value, a = value[a > 1], a[a > 1].astype(np.float64)
    b = np.zeros(len(value))
    for _, h, _, _ in documents_of(once[y[once] == 0]):
        at = np.searchsorted(value, own := np.unique(h))
        at[at == len(value)] = 0
        b[at[value[at] == own] if len(value) else at[:0]] += 1
    p, n = y[once].sum(), (1 - y[once]).sum()
    c, d = p - a, n - b
    chi2 = (a + b + c + d) * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * p * n, 1e-9)
    chosen = np.flatnonzero((a * n > b * p) & (chi2 >= LEAST_CHI2))
    chosen = np.sort(chosen[np.argsort(-chi2[chosen], kind="stable")][:FEATURES])
    model = Model(value[chosen], np.zeros(len(chosen)), 0.0)

    # Sentences that hold a feature, as (document, sentence) rows of a sparse matrix; the others count by number.
    doc, feature, sentence, total = [], [], [], np.zeros(len(y))
    for i, h, s, n_sentences in documents_of(np.arange(len(y))):
        which, f = model.find(h)
        doc.append(np.full(len(which), i)), sentence.append(s[which]), feature.append(f)
        total[i] = n_sentences
    doc, sentence, feature = (np.concatenate(x) for x in (doc, sentence, feature))
    pairs, row = np.unique(np.stack([doc, sentence], 1), axis=0, return_inverse=True)
    of = pairs[:, 0]
    row, feature = np.unique(np.stack([row.reshape(-1), feature], 1), axis=0).T
    bare = total - np.bincount(of, minlength=len(y))
    w, bias = np.full(len(chosen), 2.0), -7.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, w[feature], len(of))
        ps, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-bias))
        log_clean = np.bincount(of, np.log1p(-np.minimum(ps, 1 - 1e-12)), len(y)) + bare * np.log1p(-p0)
        clean = np.exp(log_clean)
        pull = np.where(y == 1, -WEIGHT * clean / np.maximum(1 - clean, 1e-9), 1.0)
        gz = pull[of] * ps
        grad = np.concatenate([np.bincount(feature, gz[row], len(w)) / len(y) + 1e-6 * w, [gz.sum() / len(y) + (pull * bare).sum() * p0 / len(y)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], min(bias - step[-1], -6.0)
    return Model(model.features, w, float(bias))


def _scored(model: Model, data: np.ndarray, off: np.ndarray, lo: int, hi: int):
    """Scores of rows lo to hi, their numbers of sentences, and of the worst sentence its score, first and end code point."""
    n = hi - lo
    at, number, features, first, end = _sentences(data, off, lo, hi)
    counts = np.zeros(n, np.int64)
    some = np.flatnonzero(np.diff(at))
    score, worst = np.zeros(n), np.full((3, n), np.nan)
    if not len(some):
        return score, counts, worst
    z = np.full(int(number[-1]) + 1, model.bias)
    held = [(number[word[which]], f) for word, h in features for which, f in [model.find(h)]]
    once = np.unique(np.concatenate([s * (FEATURES + 1) + f for s, f in held]))
    np.add.at(z, once // (FEATURES + 1), model.weights[once % (FEATURES + 1)])
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    s0 = number[at[some]]
    counts[some] = number[at[some + 1] - 1] - s0 + 1
    score[some] = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), s0))
    top = np.maximum.reduceat(p, s0)
    sentence = np.minimum.reduceat(np.where(p == np.repeat(top, counts[some]), np.arange(len(p)), len(p)), s0)
    points = np.concatenate(([0], np.cumsum((data[off[lo] : off[hi]] & 0xC0) != 0x80)))
    begin = np.searchsorted(number, sentence)
    last = np.searchsorted(number, sentence, "right") - 1
    row_start = points[(off[lo:hi] - off[lo])[some]]
    worst[:, some] = top, points[first[begin]] - row_start, points[end[last]] - row_start
    return score, counts, worst


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, score, sentences, worst_score, worst_start, worst_end (code points of the sentence with the highest score; null without sentences)."""
    sent = prepare(documents.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in slices(off):
                p, n, worst = _scored(sent.value, data, off, lo, hi)
                none = np.isnan(worst[0])
                places = [pa.array(np.where(none, 0, x).astype(np.int64), mask=none) for x in worst[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array(n), pa.array(worst[0], mask=none), *places], names=["doc_id", "score", "sentences", "worst_score", "worst_start", "worst_end"])

    wanted = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, score double, sentences long, worst_score double, worst_start long, worst_end long")


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    sent = prepare(documents.sparkSession).sparkContext.broadcast(model)
    position = documents.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(position))
            keep = np.ones(batch.num_rows, bool)
            for lo, hi in slices(off):
                keep[lo:hi] = _scored(sent.value, data, off, lo, hi)[0] < threshold
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
