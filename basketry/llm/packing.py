"""Packing by power-of-two decomposition.

A document of n tokens becomes floor(n / longest) pieces of the longest length and one
piece for every bit of the rest, so every piece is a power of two long. Each piece is a
sequence of its own and pieces of one length share a bucket: batches are drawn from one
bucket at a time, so nothing is padded and no sequence crosses documents.

Every row is handled by itself: one pass over the input, no shuffle. Null and empty
texts give the one piece of their end token. Repeated rows, rows that share an id and rows
with a null id are packed each. There are no ties: a document's pieces are in the order of
its tokens, its longest ones first. Very long texts are taken whole; a worker holds one of
them with its ids at a time. An empty table gives an empty result. Other columns of the
input are left out, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._spark import prepare
from basketry.llm._text import AS_IS, NOT_BLANK, slices, utf8, words

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: Pieces leave a worker in batches of about so many bytes.
BATCH_BYTES = 4 << 20
#: A space at the end or before other white space: there, words between spaces may not be the tokenizer's own parts.
_WIDE = re.compile(r" (?:\s|\Z)")
# The pattern that splits a text before the merges, and the bytes of characters that any version of Unicode's tables puts in the same class (ASCII without controls, and U+00C0 to U+023F).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = np.ones(256, np.int64)
_RARE[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = 0


class Encoder:
    """Ids of texts as little-endian 32-bit numbers.

    The tokenizer's own pattern starts a new part at every space that something other than
    white space follows, and its merges never cross parts. So the ids of a text are those
    of its words with the space before each, and each word is merged once for a slice of
    texts. A text in which a space ends it or has white space behind it is taken whole, and
    so is one that holds the text of one of the tokenizer's added tokens: that is the
    token, as in the library, unless the tokenizer is told to encode it as ordinary text.

    What isn't known yet is merged by a faster library where that must give the same ids:
    for common characters, if the vocabulary numbers its merges in their order.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if not (t.special and special_as_text)]
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        vocab, merges = model["vocab"], model["merges"]
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        if any(vocab.get(x) != 256 + i for i, x in enumerate(joined)) or any(vocab.get(c, 256) > 255 for c in to_byte):
            return None
        ranks = {bytes(to_byte[c] for c in x): vocab[x] for x in [*to_byte, *joined]}
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(x) for x in ranks]
        return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _holds_added(self, text: bytes) -> bool:
        return any(x in text for x in self.added)

    def _whole(self, text: bytes) -> bytes:
        if self.fast is not None and not _RARE[np.frombuffer(text, np.uint8)].any() and not self._holds_added(text):
            return np.array(self.fast.encode_ordinary(text.decode()), np.uint32).tobytes()
        return self._batch([text.decode()])[0].tobytes()

    def _words(self, seg: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words with a space before each: all together, and of each word where they begin and how many they are."""
        rare = np.concatenate(([0], np.cumsum(_RARE[seg])))
        easy = (rare[end] == rare[first]) & (self.fast is not None)
        begin, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        flat = np.zeros(0, np.uint32)
        if easy.any():
            long = (end - first + 1)[easy]
            stop = np.cumsum(long)
            text = seg[np.maximum(np.arange(stop[-1]) + np.repeat(first[easy] - 1 - (stop - long), long), 0)]
            text[stop - long] = 32
            flat = np.array(self.fast.encode_ordinary(text.tobytes().decode()), np.uint32)
            cut = np.searchsorted(np.cumsum(self.bytes_of[flat]), stop) + 1
            begin[easy], size[easy] = np.concatenate(([0], cut[:-1])), np.diff(cut, prepend=0)
        if not easy.all():
            more = self._batch([" " + seg[i:j].tobytes().decode() for i, j in zip(first[~easy].tolist(), end[~easy].tolist())])
            n = np.array([len(x) for x in more])
            begin[~easy], size[~easy] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, *more])
        return flat, begin, size

    def encode(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> list[bytes]:
        """The ids of rows lo to hi of a string column's bytes."""
        texts = [data[off[i] : off[i + 1]].tobytes() for i in range(lo, hi)]
        h, at, first, end = words(data, off, lo, hi, NOT_BLANK, AS_IS)
        if not len(h):
            return [self._whole(t) for t in texts]
        _, idx, inverse = np.unique(h, return_index=True, return_inverse=True)
        seg = data[off[lo] : off[hi]]
        flat, begin, size = self._words(seg, first[idx], end[idx])
        n = size[inverse]
        total = np.cumsum(n)
        ids = flat[np.arange(total[-1]) + np.repeat(begin[inverse] - (total - n), n)]
        cut = np.concatenate(([0], total))
        out = []
        for i, t in enumerate(texts):
            if not t or _WIDE.search(t.decode()) or self._holds_added(t):
                out.append(self._whole(t))
            elif t[0] == 32:
                out.append(ids[cut[at[i]] : cut[at[i + 1]]].tobytes())
            else:
                out.append(self._whole(seg[first[at[i]] : end[at[i]]].tobytes()) + ids[cut[at[i] + 1] : cut[at[i + 1]]].tobytes())
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    if (path, special_as_text) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]


def pieces(n: int, longest: int) -> list[int]:
    """Lengths, longest first, that sum to n; each a power of two of at most `longest`, itself one."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(documents: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset, bucket. With special_as_text, the texts of special tokens are no tokens."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    prepare(documents.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        encode = encoder(tokenizer, special_as_text).encode
        rows: list[list] = [[], [], [], [], []]
        size = 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            data, off = utf8(batch.column(1))
            for lo, hi in slices(off):
                for doc, ids in zip(docs[lo:hi], encode(data, off, lo, hi)):
                    ids += end
                    n, start = len(ids) >> 2, 0
                    for length in pieces(n, longest):
                        for column, x in zip(rows, (doc, start, length, n, ids[4 * start : 4 * (start + length)])):
                            column.append(x)
                        start += length
                    size += len(ids) + 64
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                        rows, size = [[], [], [], [], []], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    wanted = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return wanted.mapInArrow(cut, SCHEMA).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """The pieces as Parquet, one folder for each length, without a shuffle."""
    packed.write.partitionBy("bucket").parquet(path)
