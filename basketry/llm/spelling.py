"""Spelling variants: each word's commonest neighbour at one edit, and the root that forms lead to.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.
A word's deletion keys are hashes of the word without one of its code points. They come
from prefix sums of a polynomial, for all places of all words of a batch at once. Words
that share a key at the same place differ there alone; a word that has another's deletion
as its whole is shorter by one. Keys go to tasks by their leading bits, are sorted there,
and only rows that meet another's go on; those are compared by the strings themselves, so a
collision of hashes makes no pair.

No pair is ever listed. Words that are equal but for one place are one group, and so are a
word and all longer ones that lose a code point to become it: the group's size and its
commonest words give each member's counts. A group has at most as many words as the
alphabet has letters (times the word's places), however the corpus is skewed. Counting
words sums up before it shuffles.

A null text has no words; a null id counts as an empty one where runs are changed. Very
long words are taken whole: their rows carry numbers, and the string is only fetched for
rows that meet another's. Repeated rows count each; of equal counts the least word in the
order of code points comes first. Other columns, whatever their names, are left out. An
empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm._spark import Scratch, prepare
from basketry.llm._text import U, mix, powers

#: Code points of words that are hashed at once.
AT_ONCE = 1 << 18
#: Leading bits of a key by which rows are dealt.
RADIX_BITS = 16
_KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("place", pa.int32()), ("last", pa.bool_())])
_MET = pa.schema([("id", pa.int64()), ("place", pa.int32()), ("replaced", pa.bool_())])


def word_counts(documents: DataFrame, letters: str = "A-Za-zÀ-ÿ", shortest: int = 7, least: int = 2, change: Callable[[Column, Column], Column] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: maximal runs of letters with A-Z lower-cased, of at least `shortest` code points and `least` occurrences. change takes (id as text, run) and gives the word to count instead."""
    text = F.translate(F.col(text_column), string.ascii_uppercase, string.ascii_lowercase)
    runs = documents.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.split(text, f"[^{letters}]+")).alias("run"))
    runs = runs.where(F.length("run") >= shortest)
    word = change(F.col("id"), F.col("run")) if change else F.col("run")
    words = runs.select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def typing_errors(one_in: int = 31) -> Callable[[Column, Column], Column]:
    """A change for word_counts: of runs whose crc32 with their document's id is divisible by one_in, the code point at that crc32 modulo the length goes."""

    def change(doc: Column, run: Column) -> Column:
        h = F.crc32(F.encode(F.concat(doc, F.lit(":"), run), "utf-8"))
        at = F.pmod(h, F.length(run)).cast("int")
        cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
        return F.when(F.pmod(h, F.lit(one_in)) == 0, cut).otherwise(run)

    return change


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word and each of its places, then for each whole word (place -1): key, index of the word, place, and whether the code point there is the last of equal ones in a row."""
    n = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    end = np.cumsum(n)
    begin = end - n
    up, down = powers(len(flat) + 2)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat.astype(np.uint64) + U(1)) * up[: len(flat)], out=sums[1:])
    owner = np.repeat(np.arange(len(words)), n)
    p, s, e = np.arange(len(flat)), begin[owner], end[owner]
    cut = (sums[p] - sums[s]) * down[s] + (sums[e] - sums[p + 1]) * down[s + 1]
    whole = (sums[end] - sums[begin]) * down[begin]
    last = np.ones(len(flat), bool)
    last[:-1] = flat[:-1] != flat[1:]
    last[end[n > 0] - 1] = True
    key = mix(np.concatenate([cut, whole]) + mix(np.concatenate([n[owner] - 1, n]).astype(np.uint64)))
    rest = np.arange(len(words))
    return key.view(np.int64), np.concatenate([owner, rest]), np.concatenate([p - s, np.full(len(words), -1)]).astype(np.int32), np.concatenate([last, np.zeros(len(words), bool)])


def meeting(key: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and place, whole groups of a key: those that share their place with another, and those of groups that have a whole word and a longer one."""
    same_key = key[1:] == key[:-1]
    same = same_key & (place[1:] == place[:-1]) & (place[1:] >= 0)
    replaced = np.zeros(len(key), bool)
    replaced[1:] |= same
    replaced[:-1] |= same
    group = np.concatenate([[0], np.cumsum(~same_key)])
    whole, cut = place < 0, last & (place >= 0)
    has = np.zeros((2, group[-1] + 1), bool)
    has[0, group[whole]] = has[1, group[cut]] = True
    return replaced, (has[0] & has[1])[group] & (whole | cut)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        sizes = np.cumsum([len(w) for w in words])
        lo = 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + AT_ONCE, "right")))
            key, index, place, last = deletion_keys(words[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[lo:hi][index]), pa.array(place), pa.array(last)], schema=_KEYS)
            lo = hi


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _KEYS.empty_table()

    def met(table: pa.Table) -> pa.RecordBatch:
        key, ids, place, last = (table.column(i).to_numpy() for i in range(4))
        replaced, longer = meeting(key, place, last)
        rows = [np.concatenate([x[replaced], x[longer]]) for x in (ids, place)]
        kind = np.concatenate([np.ones(int(replaced.sum()), bool), np.zeros(int(longer.sum()), bool)])
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(kind)], schema=_MET)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(_KEYS)])
        key = table.column(0).to_numpy()
        # The last key may go on in the next batch; a group is small.
        cut = int(np.argmax(key == key[-1]))
        held = table.slice(cut)
        if cut:
            yield met(table.slice(0, cut))
    if held.num_rows:
        yield met(held)


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Of a table (word, n) with each word once: word, form, root, n, n_near, form_n. The form is the commonest near word if it is at least so many times as common, else null; the root is what forms lead to, the word itself if it has none."""
    spark = prepare(words.sparkSession)
    scratch = Scratch(spark)
    words = scratch.save(words.select("word", F.col("n").cast("long").alias("n"), F.monotonically_increasing_id().alias("id")), "words")
    keys = words.select("id", "word").mapInArrow(_keys, "key long, id long, place int, last boolean")
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "place")
    rows = dealt.mapInArrow(_meeting, "id long, place int, replaced boolean").join(words, "id")
    base = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.substr("word", F.lit(1), F.col("place")), F.substr(F.col("word"), F.col("place") + 2)))
    # The least of these is the commonest word, of equal ones the least.
    rows = rows.select("id", "place", "replaced", base.alias("base"), F.struct((-F.col("n")).alias("n"), "word").alias("own"))

    together = Window.partitionBy("place", "base")
    others = rows.where("replaced").select(
        "id",
        (F.count(F.lit(1)).over(together) - 1).alias("near"),
        F.when(F.row_number().over(together.orderBy("own")) == 1, F.lead("own").over(together.orderBy("own"))).otherwise(F.min("own").over(together)).alias("best"),
    )
    around = Window.partitionBy("base")
    short = F.col("place") < 0
    longer = rows.where("NOT replaced").select(
        "id",
        F.when(short, F.count(F.when(~short, 1)).over(around)).otherwise(F.count(F.when(short, 1)).over(around)).alias("near"),
        F.when(short, F.min(F.when(~short, F.col("own"))).over(around)).otherwise(F.min(F.when(short, F.col("own"))).over(around)).alias("best"),
    )
    near = others.unionByName(longer).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.n") >= F.lit(times) * F.col("n")
    found = words.join(near, "id", "left").select(
        "word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.n")).alias("form_n")
    )
    found = scratch.save(found, "variants")
    return _rooted(found, scratch, times)


def _rooted(found: DataFrame, scratch: Scratch, times: int) -> DataFrame:
    """found with the root of each word. Every step's form is `times` as common, so the largest count bounds the steps; each round doubles them. With times of 1 or less, forms might lead in a circle, so that is refused."""
    if times < 2:
        raise ValueError("times must be 2 or more")
    most, least = found.agg(F.max("n"), F.min("n")).first()
    steps, reach = 0, least or 1
    while reach * times <= (most or 0):
        steps, reach = steps + 1, reach * times
    leads = scratch.save(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, steps - 1).bit_length()):
        further = leads.select(F.col("word").alias("at"), F.col("root").alias("next"))
        leads = scratch.save(leads.join(further, leads["root"] == further["at"], "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    scratch.drop("words")
    return found.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
