"""Near duplicates by a join on MinHash signature coordinates.

1. Every document's set of word shingles gets a signature of K minimum hashes. Documents
   with equal sets (told by count and a 128-bit fingerprint) become one class, known by a
   number; copies go no further.
2. Each class is posted under its K (coordinate, value) pairs. Two classes are a candidate
   pair when they collide in T coordinates or more. A posting that stands alone can't
   collide, so a class with fewer than T postings in company has no partner and is skipped
   with all of them; that is repeated while it still removes many.
3. Prefix: let all classes order their m postings in company alike, rare ones first. Of two
   classes with T collisions, one of the collisions is among the first m - T + 1 of either.
   Only these prefixes are kept as lists, so common values are hardly ever listed.
4. Lists are merged in rounds. In the first every class meets, in each of its lists, the
   class whose postings have most company, as the original of many copies has; in later
   ones the first class or the last in an order by chance that changes with the round. It
   keeps the partner that it meets in most lists. Lists within one component and partners of the
   own component are skipped. Collisions of the partners are counted on their signatures;
   pairs of T or more are confirmed on their full sets, and confirmed links give components.
   A round's work is in proportion to the lists, however many near copies a list has. Rounds
   go on while they link much.
5. What is still open is finished pair by pair. Short lists are merged: pairs of different
   components under a list are put together by pair, counted and confirmed. A long list is
   split by the classes' numbers into blocks; a block of classes outside of the list's
   largest component meets each block in a task of its own, where a pair that shares an
   earlier list is passed over and a class that is linked needs no further confirmation by
   the same component. Only links leave the task.
6. Components of all links are those of all pairs above the threshold.

T is the highest number with which a pair at the threshold is missed with a probability of
at most 1e-6: at 80 % similarity, collisions of 48 are fewer than 24 with a probability of
7.8e-7. Thresholds below 26 % have no such T and are refused.

Null or empty texts and texts without words have an empty set and no links. A text of
fewer words than a shingle is one shingle. Rows with a null id have no links and stay.
Rows that share an id are one node, whatever their texts, so ties among them don't arise;
of a component's ids the smallest names it. An empty table gives an empty result. Very
long texts are taken whole. Other columns, with whatever names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._spark import BROADCAST_ROWS, Scratch, prepare, sized
from basketry.llm._text import NOT_SPACE, grams, mix, slices, utf8, words
from basketry.llm.graph import components

K = 48
#: Probability at most with which a pair at the threshold is missed.
MISSED = 1e-6
#: Classes of a list up to which it is merged pair by pair; a longer one is split in blocks.
SHORT = 64
#: Classes, and bytes of their sets, of a block on average; two blocks meet in a task.
BLOCK_ROWS, BLOCK_BYTES = 2048, 4 << 20
#: Members that one copy of a partner's set serves.
SERVED = 256
#: A further round is worth while if the last one found more links than this share of the components that were open.
WORTH = 0.05
#: The columns that tell a set.
SET = ["n_shingles", "fp_sum", "fp_xor"]

U = np.uint64
_rng = np.random.default_rng(4)
_FLIP = _rng.integers(1, 2**63, K, dtype=np.uint64)
_TIMES = _rng.integers(1, 2**63, K, dtype=np.uint64) | U(1)


def least_collisions(percent: int) -> int:
    """T for a threshold: the most collisions of K that a pair at the threshold has with a probability of 1 - MISSED or more."""
    p, missed, t = percent / 100, 0.0, 0
    if not 0 < p <= 1:
        raise ValueError(f"percent must be above 0 and at most 100, not {percent}")
    while t < K and (missed := missed + math.comb(K, t) * p**t * (1 - p) ** (K - t)) <= MISSED:
        t += 1
    if not t:
        raise ValueError(f"{K} coordinates can't find pairs of {percent} % without missing more than {MISSED} of them")
    return t


def _shingles(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, behind the last, hashes of the rows' shingles, where each row's begin. Rows' shingles may repeat."""
    for lo, hi in slices(off):
        h, at, _, _ = words(data, off, lo, hi, NOT_SPACE)
        n = np.diff(at)
        g = grams(h, k)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        to = np.cumsum(count)
        begin = to - count
        index = np.arange(to[-1]) + np.repeat(at[:-1] - begin, count)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(g) < len(h) or not len(g):
            g = np.concatenate([g, np.zeros(len(h) - len(g), np.uint64)])
        s = g[index]
        for r in short.tolist():
            s[begin[r]] = grams(h[at[r] : at[r + 1]], int(n[r]))[0]
        yield lo, hi, s, np.concatenate((begin, to[-1:]))


def signatures(documents: DataFrame, shingle: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, mark (hash of the text), n_shingles, fp_sum, fp_xor (fingerprint of the set), sig (K 32-bit values; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            for lo, hi, s, at in _shingles(data, off, shingle):
                n = np.diff(at)
                some = np.flatnonzero(n)
                sig = np.empty((len(some), K), np.uint32)
                for c in range(K if len(some) else 0):
                    sig[:, c] = np.minimum.reduceat((s ^ _FLIP[c]) * _TIMES[c], at[some]) >> U(32)
                count, total, flips = (np.zeros(hi - lo, np.int64) for _ in range(3))
                for r in some.tolist():
                    own = np.unique(s[at[r] : at[r + 1]])
                    count[r] = len(own)
                    total[r], flips[r] = own.sum().view(np.int64), np.bitwise_xor.reduce(mix(own + U(77))).view(np.int64)
                ends = np.concatenate(([0], np.cumsum((n > 0) * K))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.reshape(-1).view(np.int32)), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(2)), *map(pa.array, (count, total, flips)), lists], names=["doc_id", "mark", *SET, "sig"])

    wanted = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("mark"), F.col(text_column).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, mark long, n_shingles long, fp_sum long, fp_xor long, sig array<int>")


def sets(rows: DataFrame, shingle: int) -> DataFrame:
    """Of rows (node, sig, text): the same with the sorted 64-bit set in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            for lo, hi, s, at in _shingles(data, off, shingle):
                raw = [np.unique(s[at[r] : at[r + 1]]).tobytes() for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(2)), pa.array(raw, pa.binary())], names=["node", "sig", "shingles"])

    return rows.select("node", "sig", "text").mapInArrow(run, "node long, sig array<int>, shingles binary")


def in_company(posted: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Of postings (key, node): node, own (its postings with others' company as (posted, key), rarest first), for nodes with `least` or more."""
    left = None
    while True:
        shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("posted")).where("posted > 1")
        own = F.sort_array(F.collect_list(F.struct("posted", "key"))).alias("own")
        nodes = scratch.save(posted.join(shared, "key").groupBy("node").agg(own).where(F.size("own") >= least), "company")
        now = nodes.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]
        if not now or left is not None and now > 0.8 * left:
            return nodes
        left, posted = now, nodes.select(F.explode("own.key").alias("key"), "node")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sent(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=LINK)


def confirmed(pairs: DataFrame, full: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b): those of the pairs (node, partner) whose sets of (node, sig, shingles) have T collisions and the similarity.

    A partner's set goes to as many tasks as its members need, SERVED to each copy.
    """
    least = least_collisions(percent)
    pairs = scratch.save(pairs.select("node", "partner").distinct(), "pairs")
    small = pairs.count() <= BROADCAST_ROWS
    copies = pairs.groupBy("partner").agg(F.ceil(F.count(F.lit(1)) / SERVED).cast("int").alias("copies"))
    copies = F.broadcast(copies) if small else copies
    members = pairs.join(copies, "partner").select("node", "partner", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"))
    members = full.join(F.broadcast(members) if small else members, "node").select("partner", "copy", F.lit(1).alias("member"), "node", "sig", "shingles")
    heads = full.join(copies, F.col("node") == F.col("partner")).select("partner", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("member"), "node", "sig", "shingles")
    rows = heads.unionByName(members).repartition("partner", "copy").sortWithinPartitions("partner", "copy", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, own = None, None
        for batch in batches:
            links = []
            sigs = batch.column(4).flatten().to_numpy().reshape(-1, K)
            for i, (partner, member, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                if not member:
                    sig, own = sigs[i].copy(), np.frombuffer(batch.column(5)[i].as_py(), np.uint64)
                elif (sig == sigs[i]).sum() >= least and _alike(own, np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64), percent):
                    links.append((node, partner))
            yield _sent(links)

    return rows.mapInArrow(run, "a long, b long")


Row = tuple[int, int, int, np.ndarray, np.ndarray]


def _met(one: list[Row], two: list[Row], percent: int, least: int) -> list[tuple[int, int]]:
    """Links between two blocks of rows (node, component, coordinates of earlier lists, signature, set), or within one (given twice): enough to tie the components that they tie.

    A pair that shares an earlier list is passed over: it is looked at there.
    """
    nodes, parts, before = (([r[k] for r in one], np.array([r[k] for r in two], np.int64)) for k in range(3))
    _, inverse = np.unique(np.concatenate((parts[0], parts[1])), return_inverse=True)
    part_a, part_b = inverse[: len(one)].copy(), inverse[len(one) :].copy()
    bits = np.int64(1) << np.arange(K, dtype=np.int64)
    early_a, early_b = ((np.array(x, np.int64)[:, None] & bits) != 0 for x in before)
    sig_a, sig_b = np.stack([r[3] for r in one]), np.stack([r[3] for r in two])
    size_a, size_b = (np.array([len(r[4]) for r in x]) for x in (one, two))
    value, places = np.unique(np.concatenate([r[4] for r in (*one, *two)]), return_inverse=True)
    places_a, places_b = np.split(places[: size_a.sum()], np.cumsum(size_a)[:-1]), places[size_a.sum() :]
    begin_b, held = np.cumsum(size_b) - size_b, np.zeros(len(value), bool)
    links = []
    for i in range(len(one)):
        same = sig_b == sig_a[i]
        wanted = (same.sum(1) >= least) & (part_b != part_a[i]) & ~(same & early_b & early_a[i]).any(1)
        wanted &= 100 * np.minimum(size_a[i], size_b) >= percent * np.maximum(size_a[i], size_b)
        if one is two:
            wanted[: i + 1] = False
        if not wanted.any():
            continue
        held[places_a[i]] = True
        common = np.add.reduceat(held[places_b].view(np.int8), begin_b, dtype=np.int64)
        held[places_a[i]] = False
        linked = np.flatnonzero(wanted & (100 * common >= percent * (size_a[i] + size_b - common)))
        _, first = np.unique(part_b[linked], return_index=True)
        for j in linked[first].tolist():
            links.append((nodes[0][i], int(nodes[1][j])))
            old, new = part_b[j], part_a[i]
            part_a[part_a == old] = new
            part_b[part_b == old] = new
    return links


def confirmed_in_blocks(lists: DataFrame, full: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) among the classes of each list (key, node, component, before): every pair of different components is looked at, in the first list that it shares."""
    least = least_collisions(percent)
    sizes = full.select("node", F.octet_length("shingles").cast("long").alias("bytes"))
    held = scratch.save(lists.join(sizes, "node"), "held")
    parts = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")
    top = F.max_by(F.struct("component", "n", "bytes"), F.struct("n", "component")).alias("top")
    totals = parts.groupBy("key").agg(top, F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select(
        "key", F.col("top.component").alias("largest"), blocks(F.col("top.n"), F.col("top.bytes")).alias("larges"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others")
    )
    placed = held.join(sized(scratch.save(totals, "totals")), "key")
    inside = F.col("component") == F.col("largest")
    block = F.pmod(F.xxhash64("node"), F.when(inside, F.col("larges")).otherwise(F.col("others"))).cast("int")
    placed = placed.select("key", "node", "component", "before", inside.alias("inside"), "larges", "others", block.alias("block"))
    # Blocks of the largest component have numbers behind those of the others; they meet the others alone.
    number = F.when(F.col("inside"), F.col("others") + F.col("block")).otherwise(F.col("block"))
    met = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("larges") - 1))
    spread = placed.select("key", "node", "component", "before", number.alias("own"), F.explode(met).alias("other"))
    rows = spread.join(full, "node").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "before", "sig", "shingles")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def meet(unit: tuple[int, int, int] | None, sides: dict[int, list[Row]]) -> list[tuple[int, int]]:
        if len(sides) == 2 or sides and unit[1] == unit[2]:
            found = list(sides.values())
            return _met(found[0], found[-1], percent, least)
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides = None, {}
        for batch in batches:
            links = []
            sigs = batch.column(7).flatten().to_numpy().reshape(-1, K)
            for x, (key, i, j, own, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:7]))):
                if (key, i, j) != unit:
                    links += meet(unit, sides)
                    unit, sides = (key, i, j), {}
                sides.setdefault(own, []).append((*row, sigs[x].copy(), np.frombuffer(batch.column(8)[x].as_py(), np.uint64)))
            yield _sent(links)
        yield _sent(meet(unit, sides))

    return rows.mapInArrow(run, "a long, b long")


def _open(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    """The lists (key, node, centre, before) with each node's component, without those in one component; with the list's length."""
    if found is None:
        placed = lists.withColumn("component", F.col("node"))
    else:
        placed = lists.join(sized(found), "node", "left").select("key", "node", "centre", "before", F.coalesce("component", "node").alias("component"))
    state = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("length")).where("low != high")
    return placed.join(state.select("key", "length"), "key")


def links(lists: DataFrame, full: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) with the components of all links among the classes that share a list, from (key, node, centre, before) and (node, sig, shingles); None without a link."""
    all_links, number, fresh, found = None, 0, False, None

    def more(new: DataFrame) -> int:
        """Adds links; how many there are."""
        nonlocal all_links, number, fresh
        number += 1
        new = scratch.save(new, f"links {number}")
        if n := new.count():
            all_links = new if all_links is None else all_links.unionByName(new)
            fresh = True
        return n

    def open_lists(lists: DataFrame) -> DataFrame:
        """_open, by the components of the links so far."""
        nonlocal fresh, found
        if fresh:
            found, fresh = components(all_links, scratch, rounds=1), False
        return _open(lists, found)

    while True:
        held = scratch.save(open_lists(lists).where(F.col("length") > SHORT * bool(number)), "open")
        parts = held.select("component").distinct().count()
        if not parts:
            break
        by_chance = F.struct(F.xxhash64("node", F.lit(number)).alias("at"), "component", "node")
        first = F.struct("centre", "component", "node") if not number else by_chance
        ends = held.groupBy("key").agg(F.max(first).alias("first"), F.min(by_chance).alias("last"))
        partner = F.when(F.col("first.component") != F.col("component"), F.col("first.node")).when(F.col("last.component") != F.col("component"), F.col("last.node"))
        met = held.join(ends, "key").select("node", partner.alias("partner")).where("partner IS NOT NULL").groupBy("node", "partner").agg(F.count(F.lit(1)).alias("n"))
        best = met.groupBy("node").agg(F.max_by("partner", F.struct("n", "partner")).alias("partner"))
        if more(confirmed(best, full, percent, scratch)) <= WORTH * parts and number > 1:
            break
    held = scratch.save(open_lists(lists), "open")
    short = held.where(F.col("length") <= SHORT)
    a, b = (short.select("key", F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("node", "partner"))
    more(confirmed(a.join(b, "key").where("node < partner AND of_node != of_partner"), full, percent, scratch))
    long = scratch.save(held.where(F.col("length") > SHORT).select("key", "node", "centre", "before"), "long")
    if long.count():
        held = scratch.save(open_lists(long).select("key", "node", "component", "before"), "open")
        more(confirmed_in_blocks(held, full, percent, scratch))
    return all_links


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    least = least_collisions(percent)
    scratch = Scratch(prepare(documents.sparkSession))
    signed = scratch.save(signatures(documents, shingle, id_column, text_column), "signatures")
    own = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = own.groupBy(*SET).agg(F.min(F.struct("doc_id", "mark")).alias("low"), F.first("sig").alias("sig"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("node"), *SET, "low", "sig"), "classes")

    posted = classes.select("node", F.posexplode("sig").alias("c", "value"))
    posted = posted.select((F.shiftleft(F.col("c").cast("long"), 32) + F.col("value")).alias("key"), "node")
    company = in_company(posted, least, scratch)
    centre = F.aggregate("own", F.lit(0).cast("long"), lambda x, y: x + y["posted"])
    bit = lambda y: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(y["key"] + (1 << 31), 32).cast("int"))
    prefix = F.slice("own", 1, F.size("own") - least + 1)
    prefix = F.transform(prefix, lambda x, i: F.struct(x["key"].alias("key"), F.aggregate(F.slice("own", 1, i), F.lit(0).cast("long"), lambda m, y: m + bit(y)).alias("before")))
    lists = company.select("node", centre.alias("centre"), F.explode(prefix).alias("own")).select("own.key", "node", "centre", "own.before")
    lists = scratch.save(lists, "lists")
    members = classes.join(company.select("node"), "node", "left_semi").select("node", "sig", F.col("low.doc_id").alias("doc_id"), F.col("low.mark").alias("mark"))
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("mark"), F.col(text_column).alias("text"))
    full = scratch.save(sets(texts.join(members, ["doc_id", "mark"]), shingle), "sets")
    scratch.drop("company")
    edges = links(lists, full, percent, scratch)

    # Rows that share an id tie their classes.
    ends = own.groupBy("doc_id").agg(*(f(c).alias(f"{n}_{c}") for c in SET for n, f in (("low", F.min), ("high", F.max))))
    shared = scratch.save(ends.where(" OR ".join(f"low_{c} != high_{c}" for c in SET)).select("doc_id"), "shared")
    if shared.count():
        ties = scratch.save(own.join(sized(shared), "doc_id").join(classes.select(*SET, "node"), SET).select("doc_id", "node").distinct(), "ties")
        ties = ties.join(ties.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
        edges = ties if edges is None else edges.unionByName(ties)
    answers = classes.select("node", *SET, F.col("low.doc_id").alias("low"))
    if edges is not None:
        placed = answers.join(components(edges, scratch), "node", "left").withColumn("component", F.coalesce("component", "node"))
        lows = placed.groupBy("component").agg(F.min("low").alias("low"))
        answers = placed.drop("low").join(lows, "component")
    joined = signed.select("doc_id", *SET).join(answers.select(*SET, "low"), SET, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("low")).otherwise(F.col("doc_id"))
    out = scratch.save(joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), "near")
    scratch.drop(*(x for x in [*scratch.paths] if x != "near"))
    return out
