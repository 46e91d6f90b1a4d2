"""Token counts of a unigram tokenizer, without its tokens.

An Aho-Corasick automaton finds every piece of the vocabulary in a text; dynamic
programming over their ends carries the best score and the number of pieces, nothing else.
The rules are those of the tokenizers library's Unigram model: of equal scores the
longest last piece wins, a character that is no piece costs the lowest score less 10, and
unknown characters count their bytes if the vocabulary has byte pieces, else once for a
run of them. Spaces are written as U+2581, and one goes before a text that isn't empty.

No piece of most vocabularies has U+2581 behind another character. Then words are
independent of each other, and if all scores are whole numbers (so that no sum is ever
rounded), the best score of a text is the sum over its words. Each word is counted once
for a slice of texts and kept in a bounded table for those that come again. With any other
vocabulary, texts are counted whole.

One pass, no shuffle. Null and empty texts have no tokens. Repeated rows, rows that share an
id and null ids are counted each. Ties of scores are settled by the rule above. Very long
texts are counted whole, by word where words are independent, else with a number for each
character. An empty table gives an empty result. Other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._spark import prepare
from basketry.llm._text import AS_IS, NOT_BLANK, SLICE, slices, utf8, words

SPACE = "▁"
UNKNOWN_COST = 10.0
#: Words that a worker keeps; beyond it, it starts anew.
CACHE = 400_000
_EDGE = re.compile(f"\\A |  | \\Z|{SPACE}")


def read_pieces(model_file: str) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece file with their scores, in order of id; the unknown piece is number 0."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


@dataclass
class Counter:
    """Counts tokens by a vocabulary of (piece, score)."""

    vocabulary: list[tuple[str, float]]
    known: dict[int, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in self.vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in self.vocabulary) - UNKNOWN_COST
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in self.vocabulary}
        inner = any(SPACE in p.lstrip(SPACE) for p, _ in self.vocabulary)
        self.by_word = not inner and all(float(s).is_integer() for _, s in self.vocabulary) and SPACE in self.single

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of a text with its spaces already written as U+2581."""
        n = len(text)
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(text):
            for end, (length, score) in self.automaton.iter(text):
                s = best[end + 1 - length] + score
                if s > best[end + 1]:
                    best[end + 1], count[end + 1] = s, count[end + 1 - length] + 1
            return count[n], best[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        loose = [False] * (n + 1)  # the best piece that ends here is an unknown character
        for end, char in enumerate(text):
            for length, score in ends[end]:
                s = best[end + 1 - length] + score
                if s > best[end + 1]:
                    best[end + 1], count[end + 1] = s, count[end + 1 - length] + 1
            if char not in self.single and best[end] + self.unknown > best[end + 1]:
                more = len(char.encode()) if self.bytes else 0 if loose[end] else 1
                best[end + 1], count[end + 1], loose[end + 1] = best[end] + self.unknown, count[end] + more, True
        return count[n], best[n]

    def whole(self, text: str) -> tuple[int, float]:
        return self.best(SPACE + text.replace(" ", SPACE)) if text else (0, 0.0)

    def rows(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters, tokens and best scores of rows lo to hi."""
        texts = [data[off[i] : off[i + 1]].tobytes().decode() for i in range(lo, hi)]
        chars = np.array([len(t) for t in texts], np.int64)
        tokens, scores = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
        if self.by_word:
            h, at, first, end = words(data, off, lo, hi, NOT_BLANK, AS_IS)
            value, idx, inverse = np.unique(h, return_index=True, return_inverse=True)
            seg, known = data[off[lo] : off[hi]].tobytes(), self.known
            if len(known) > CACHE:
                known.clear()
            results = []
            for v, i, j in zip(value.tolist(), first[idx].tolist(), end[idx].tolist()):
                if (r := known.get(v)) is None:
                    r = known[v] = self.best(SPACE + seg[i:j].decode())
                results.append(r)
            for out, k in ((tokens, 0), (scores, 1)):
                each = np.array([r[k] for r in results], out.dtype)[inverse] if results else np.zeros(0, out.dtype)
                sums = np.concatenate(([0], np.cumsum(each)))
                out[:] = sums[at[1:]] - sums[at[:-1]]
        for i, t in enumerate(texts):
            if not self.by_word or _EDGE.search(t):
                tokens[i], scores[i] = self.whole(t)
        return chars, tokens, scores


_counters: dict[int, Counter] = {}


def count_tokens(documents: DataFrame, vocabulary: list[tuple[str, float]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, n_tokens, best_score."""
    sent = prepare(documents.sparkSession).sparkContext.broadcast(vocabulary)
    key = hash(tuple(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters[key] = Counter(sent.value)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in slices(off, 2 * SLICE):
                out = _counters[key].rows(data, off, lo, hi)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, out)], names=["doc_id", "n_chars", "n_tokens", "best_score"])

    wanted = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, best_score double")
