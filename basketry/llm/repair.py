"""Repair of conversations: the cheapest edits that give a well-formed order of roles.

A conversation is well-formed if the initials of its roles read `(s?(ua)+)?`. Each turn is
kept (K, no cost), given the other role (R, 1) or deleted (D, 2); turns without text and
turns that say again what the role has said before must be deleted, and a turn that breaks
off costs 5 more unless deleted. An empty turn of the user or assistant may be inserted
anywhere (I, 5). Of the cheapest repairs the one whose edits, read as letters, come first
is taken.

Where the order stands after some turns is one of four states, so the costs of a stretch
of turns are a matrix of four by four: from the state before it to the state behind.
Turns are sorted over all tasks by ranges and cut into stretches of at most STRETCH turns
and STRETCH_BYTES of text. Stretches of one length are a tensor with the turn as its first
axis: the matrices, and then the costs from each turn to the end, are computed for all
stretches at once, turn by turn from the last; then all edits are traced, turn by turn
from the first. A conversation of one stretch needs no more. Of longer ones the matrices
are multiplied (sums and minima) within each block of the sorted turns and then over its
blocks, so that no task gets a conversation's turns together, however many they are.

The hash of a repaired text needs its bytes in order: those of conversations of several
stretches are hashed stretch by stretch in one task, which holds one batch of them.

Turns are taken by number, null ones first; equal ones by role, a hash of the text, and
then the place in the input. A null role or text is a space. A null conversation id is a
conversation. Repeated rows are turns that say again what was said. A turn's role counts by
its initial. Very long texts are taken whole, in stretches of their own. Other columns,
whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm._spark import Scratch, prepare

RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STRETCH, STRETCH_BYTES = 256, 1 << 20
#: Numbers of a tensor that is computed at once.
AT_ONCE = 1 << 21
#: More than any cost, and small enough to be added a few times.
NEVER = 1 << 60
#: Initials as codes; 0 is any other.
CODES = {"s": 1, "u": 2, "a": 3}
#: By state (0 nothing yet, 1 after system, 2 after user, 3 after assistant): the state that a turn of each initial leads to, or -1.
KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: By state: the state behind a turn that is inserted or given another role.
NEXT = np.array([2, 2, 3, 2])
#: By state: the least cost to end there.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
BLANK, AGAIN, BROKEN = 1, 2, 3
_ROLE = {2: "user", 3: "assistant"}

_STRETCHES = "conv_id long, block int, seg int, roles array<string>, texts array<string>, turns array<long>, codes binary, digests array<binary>, illegal long"
_MATRICES = "conv_id long, block int, seg int, codes binary, m array<long>, blank long, duplicate long, truncated long"


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (x for x in batches if x.num_rows)


def _rows(schema: str, *columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)


def _longs(a: np.ndarray) -> pa.Array:
    """Rows of an array with two axes as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a, np.int64).reshape(-1)))


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.to_pylist()]


def buckets(codes: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of about one length together: their numbers, and initials and faults as arrays of (turn, stretch). Turns beyond a stretch's end have the fault 255. width: numbers that are held for each turn."""
    n = np.array([len(x) for x in codes])
    order = np.argsort(n, kind="stable")
    lo = 0
    while lo < len(order):
        # Lengths within a bucket differ by a quarter at most.
        hi = int(np.searchsorted(n[order], n[order[lo]] + n[order[lo]] // 4, "right"))
        hi = min(hi, lo + max(1, AT_ONCE // (width * max(1, int(n[order[hi - 1]])))))
        which = order[lo:hi]
        length = int(n[which[-1]])
        both = np.full((len(which), length), 255, np.uint8)
        both[np.arange(length) < n[which][:, None]] = np.concatenate([codes[i] for i in which]) if length else 0
        both = both.T
        yield which, both & 3, np.where(both == 255, 255, both >> 2)
        lo = hi


def _step(initial: np.ndarray, fault: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Costs before a turn, of all stretches, from the costs behind it (stretch, state, more axes); and the costs if the turn is the next to be deleted, kept or renamed, by state."""
    tail = (slice(None), *(None,) * (later.ndim - 2))
    stays = np.where((fault == BLANK) | (fault == AGAIN), NEVER, np.where(fault == BROKEN, TRUNCATED, 0))[tail]
    delete, keep, rename, now = [], [], [], []
    for q in range(4):
        to = KEPT[q][initial]
        kept = np.take_along_axis(later, np.maximum(to, 0).reshape(-1, *(1,) * (later.ndim - 1)), 1)[:, 0]
        delete.append(later[:, q] + DELETE)
        keep.append(np.where((to < 0)[tail], NEVER, kept + stays))
        rename.append(later[:, NEXT[q]] + RENAME + stays)
        now.append(np.minimum(np.minimum(delete[q], keep[q]), rename[q]))
    after_user, after_assistant = np.minimum(now[2], now[3] + INSERT), np.minimum(now[3], now[2] + INSERT)
    best = np.stack([np.minimum(now[0], after_user + INSERT), np.minimum(now[1], after_user + INSERT), after_user, after_assistant], 1)
    best = np.minimum(best, NEVER)
    return np.where((fault == 255)[(slice(None), *(None,) * (later.ndim - 1))], later, best), [delete, keep, rename]


def matrices(codes: list[np.ndarray]) -> np.ndarray:
    """The least cost of each stretch from every state to every state."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for which, initial, fault in buckets(codes, 16):
        cost = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(which), 4, 4)).astype(np.int64)
        for t in range(len(initial) - 1, -1, -1):
            cost, _ = _step(initial[t], fault[t], cost)
        out[which] = cost
    return out


def traced(codes: list[np.ndarray], behind: np.ndarray, state: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of each stretch, by the costs behind it and the state before it: the edits, the state behind, and the cost from there to the conversation's end. What ends a conversation has the last inserts too."""
    edits: list[bytes] = [b""] * len(codes)
    out, total = state.copy(), np.empty(len(codes), np.int64)
    for which, initial, fault in buckets(codes, 4):
        n = len(which)
        cost = np.empty((len(initial) + 1, n, 4), np.int64)
        cost[-1] = behind[which]
        for t in range(len(initial) - 1, -1, -1):
            cost[t], _ = _step(initial[t], fault[t], cost[t + 1])
        q, row = state[which].copy(), np.arange(n)
        total[which] = cost[0][row, q]
        seen = np.zeros((len(initial), n, 4), np.uint8)
        for t in range(len(initial)):
            _, choices = _step(initial[t], fault[t], cost[t + 1])
            delete, keep, rename = (np.stack(x, 1) for x in choices)
            open_ = fault[t] != 255
            for slot in range(3):
                here = cost[t][row, q]
                inserts = open_ & (delete[row, q] != here) & (cost[t][row, NEXT[q]] + INSERT == here)
                seen[t, inserts, slot] = ord("I")
                q = np.where(inserts, NEXT[q], q)
            here = cost[t][row, q]
            gone, kept = delete[row, q] == here, keep[row, q] == here
            seen[t, :, 3] = np.where(open_, np.where(gone, ord("D"), np.where(kept, ord("K"), ord("R"))), 0)
            q = np.where(~open_ | gone, q, np.where(kept, KEPT[q, initial[t]], NEXT[q]))
        letters = seen.transpose(1, 0, 2).reshape(n, -1)
        last = {0: b"", 1: b"II", 2: b"I", 3: b""}
        for i, k in enumerate(which):
            edits[k] = letters[i][letters[i] > 0].tobytes() + (last[int(q[i])] if ends[k] else b"")
        out[which] = q
    return edits, out, total


def rewritten(edits: str, roles: list[str], texts: list[str], state: int) -> list[str]:
    """Lines `role:text` of a stretch after its edits."""
    lines, t = [], 0
    for e in edits:
        if e == "I":
            state = int(NEXT[state])
            lines.append(f"{_ROLE[state]}:")
            continue
        if e == "K":
            state = int(KEPT[state, CODES[roles[t][0]]])
            lines.append(f"{roles[t]}:{texts[t]}")
        elif e == "R":
            state = int(NEXT[state])
            lines.append(f"{_ROLE[state]}:{texts[t]}")
        t += 1
    return lines


def _cut(stretch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a block to stretches of so many at most. Pairs of neighbours within the block are judged here."""
    seg, before = 0, None
    for batch in filled(batches):
        n = batch.num_rows
        conv, block = batch.column("conv_id"), batch.column("block")[0].as_py()
        known, number = conv.is_valid().to_numpy(False), conv.fill_null(0).to_numpy()
        code = batch.column("code").to_numpy().astype(np.uint8)
        size = pc.binary_length(batch.column("text")).to_numpy()
        new = np.ones(n, bool)
        new[1:] = (number[1:] != number[:-1]) | (known[1:] != known[:-1])
        initial = (code & 3).astype(np.int64)
        ahead = np.empty(n, np.int64)
        ahead[1:] = initial[:-1]
        joined = ~new
        joined[0] = before is not None and before[:2] == (known[0], number[0])
        ahead[0] = before[2] if before else 0
        wrong = joined & ~np.isin(ahead * 4 + initial, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))
        before = (known[-1], number[-1], initial[-1])
        begin = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        sums = np.cumsum(size)
        within = (sums - np.repeat((sums - size)[begin], np.diff(np.append(begin, n)))) // STRETCH_BYTES
        cuts = new | (place % stretch == 0)
        cuts[1:] |= within[1:] != within[:-1]
        first = np.flatnonzero(cuts)
        offsets = pa.array(np.append(first, n).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, batch.column(x)) for x in ("role", "text", "turn")]
        data = code.tobytes()
        ends = np.append(first, n)
        yield _rows(
            _STRETCHES,
            conv.take(pa.array(first)),
            np.full(len(first), block, np.int32),
            np.arange(seg, seg + len(first), dtype=np.int32),
            *lists,
            [data[a:b] for a, b in zip(ends[:-1], ends[1:])],
            pa.ListArray.from_arrays(offsets, batch.column("digest")),
            np.add.reduceat(wrong, first).astype(np.int64),
        )
        seg += len(first)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slim stretches with their first sayings to codes with all faults, and matrices."""
    for batch in filled(batches):
        codes = []
        for raw, firsts in zip(batch.column("codes").to_pylist(), batch.column("firsts").to_pylist()):
            code = np.frombuffer(raw, np.uint8).copy()
            first = code >> 2 == BLANK
            first[np.array(firsts or [], int)] = True
            code[~first] = code[~first] & 3 | AGAIN << 2
            codes.append(code)
        faults = [np.bincount(x >> 2, minlength=4) for x in codes]
        counts = np.array(faults).reshape(-1, 4)
        yield _rows(_MATRICES, *(batch.column(x) for x in ("conv_id", "block", "seg")), [x.tobytes() for x in codes], _longs(matrices(codes).reshape(-1, 16)), *(counts[:, k].astype(np.int64) for k in (BLANK, AGAIN, BROKEN)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), NEVER)


def suffixes(m: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Products of each matrix with all later ones of its group (neighbouring rows), all at once in rounds that double the reach."""
    m, reach = m.copy(), 1
    size = np.diff(np.append(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group))).max(initial=0)
    while reach < size:
        same = np.flatnonzero(group[:-reach] == group[reach:])
        m[same] = _product(m[same], m[same + reach])
        reach *= 2
    return m


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut between groups of the keys, and the groups' numbers. A group is held as a whole: callers' groups are small."""
    held = None
    for batch in filled(batches):
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        group = _numbers(held, keys)
        cut = int(np.argmax(group == group[-1]))
        if cut:
            yield held.slice(0, cut).combine_chunks(), group[:cut]
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), _numbers(held, keys)


def _numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        c = table.column(k)
        value, known = c.fill_null(0).to_numpy(), c.is_valid().to_numpy()
        new[1:] |= (value[1:] != value[:-1]) | (known[1:] != known[:-1])
    return np.cumsum(new)


def _cells(table: pa.Table, name: str, width: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(False).astype(np.int64).reshape(table.num_rows, *(4,) * (2 if width == 16 else 1))


_BEHIND = "conv_id long, block int, seg int, behind array<long>"


def behind(stretches: DataFrame, last: np.ndarray) -> DataFrame:
    """conv_id, block, seg, behind: for stretches of matrices (m), the vector behind each: all later matrices of the conversation times `last`. A task multiplies a conversation's stretches of one block, or its blocks."""

    def blocks(batches):
        for t, group in _whole_groups(batches, ["conv_id", "block"]):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            yield _rows("conv_id long, block int, m array<long>", *(t.column(x).combine_chunks().take(pa.array(first)) for x in ("conv_id", "block")), _longs(suffixes(_cells(t, "m", 16), group)[first].reshape(-1, 16)))

    def after(m, group, final):
        """Vectors behind the rows: final (by row) where a group ends."""
        product = suffixes(m, group)
        vector = np.minimum((product + final[:, None, :]).min(2), NEVER)
        out = final.copy()
        goes_on = np.flatnonzero(group[1:] == group[:-1])
        out[goes_on] = vector[goes_on + 1]
        return out

    def over(batches):
        for t, group in _whole_groups(batches, ["conv_id"]):
            final = np.broadcast_to(last, (t.num_rows, 4)).astype(np.int64)
            yield _rows("conv_id long, block int, final array<long>", t.column("conv_id").combine_chunks(), t.column("block").combine_chunks(), _longs(after(_cells(t, "m", 16), group, final)))

    def within(batches):
        for t, group in _whole_groups(batches, ["conv_id", "block"]):
            yield _rows(_BEHIND, *(t.column(x).combine_chunks() for x in ("conv_id", "block", "seg")), _longs(after(_cells(t, "m", 16), group, _cells(t, "final", 4))))

    stretches = stretches.select("conv_id", "block", "seg", "m")
    dealt = stretches.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seg")
    products = dealt.mapInArrow(blocks, "conv_id long, block int, m array<long>")
    finals = products.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(over, "conv_id long, block int, final array<long>")
    finals = finals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "final")
    both = stretches.join(finals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "block", "seg", "m", "final")
    return both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seg").mapInArrow(within, _BEHIND)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind each stretch from each state before it, as a matrix of 0 and NEVER that is turned over, with its order reversed: then a vector behind is the state before."""
    for batch in filled(batches):
        codes, vectors = _codes(batch.column("codes")), _cells(pa.Table.from_batches([batch]), "behind", 4)
        m = np.full((len(codes), 4, 4), NEVER, np.int64)
        for q in range(4):
            _, out, _ = traced(codes, vectors, np.full(len(codes), q), np.zeros(len(codes), bool))
            m[np.arange(len(codes)), out, q] = 0
        yield _rows("conv_id long, block int, seg int, m array<long>", batch.column("conv_id"), *(pa.array(-batch.column(x).to_numpy()) for x in ("block", "seg")), _longs(m.reshape(-1, 16)))


_EDITED = "conv_id long, block int, seg int, edits string, state int, cost long"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in filled(batches):
        n = batch.num_rows
        t = pa.Table.from_batches([batch])
        known = batch.column("behind").is_valid().to_numpy(False)
        vectors = np.broadcast_to(END, (n, 4)).copy()
        state = np.zeros(n, np.int64)
        if known.any():
            some = t.filter(pa.array(known))
            vectors[known] = _cells(some, "behind", 4)
            state[known] = _cells(some, "before", 4).argmin(1)
        ends = batch.column("ends").to_numpy(False)
        edits, _, total = traced(_codes(batch.column("codes")), vectors, state, ends)
        yield _rows(_EDITED, *(batch.column(x) for x in ("conv_id", "block", "seg")), [x.decode() for x in edits], pa.array(state.astype(np.int32)), total)


_LINES = "conv_id long, block int, seg int, alone boolean, sha256 string, lines array<string>"


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired stretches, and the hash where one is a conversation."""
    for batch in filled(batches):
        hashes, lines = [], []
        for edits, roles, texts, state, alone in zip(*(batch.column(x).to_pylist() for x in ("edits", "roles", "texts", "state", "alone"))):
            lines.append(rewritten(edits, roles, texts, state))
            hashes.append(hashlib.sha256("\n".join(lines[-1]).encode()).hexdigest() if alone else None)
        yield _rows(_LINES, *(batch.column(x) for x in ("conv_id", "block", "seg", "alone")), pa.array(hashes, pa.string()), pa.array(lines, pa.list_(pa.string())))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines to one hash for each conversation; a hash goes on over batches."""
    now, h, some = None, None, False
    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])
    for batch in batches:
        done: list[tuple] = []
        for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if h is None or conv != now:
                if h is not None:
                    done.append((now, h.hexdigest()))
                now, h, some = conv, hashlib.sha256(), False
            for line in lines:
                h.update(b"\n" + line.encode() if some else line.encode())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], schema=schema)
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()])], schema=schema)


def stretches_of(conversations: DataFrame, scratch: Scratch, stretch: int = STRETCH) -> DataFrame:
    """The saved stretches of sorted turns: conv_id, block, seg, roles, texts, turns, codes (initial and 4 times the fault, sayings that come again not yet found), digests of role and text (null for blank turns), and ill-matched neighbours."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("tie"))
    turns = turns.withColumn("h", F.xxhash64("text"))
    order = ("conv_id", "turn", "role", "h", "tie")
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    initial = F.coalesce(*(F.when(F.col("role").startswith(k), v) for k, v in CODES.items()), F.lit(0))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 0).otherwise(BROKEN)
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turns = turns.select("conv_id", "turn", "role", "text", (initial + 4 * fault).cast("int").alias("code"), F.when(~blank, said).alias("digest"), F.spark_partition_id().alias("block"))
    return scratch.save(turns.mapInArrow(partial(_cut, stretch), _STRETCHES), "stretches")


class Repaired(NamedTuple):
    """conversations: a row for each. turns: rows (conv_id, block, seg, lines), by whose order the lines `role:text` of a conversation follow."""

    conversations: DataFrame
    turns: DataFrame


def repair(conversations: DataFrame, ids: DataFrame | None = None, stretch: int = STRETCH) -> Repaired:
    """Of (conv_id, turn, role, text) the repaired turns, and for each conversation: conv_id, gaps (numbers missing between the least and the largest turn), blank, duplicate and truncated turns by their first fault, illegal (neighbours other than su, ua, au), cost, audit (the edits) and repaired_sha256 (of `role:text` lines). ids: conversations (conv_id) to list too if they have no turns. stretch: turns of a stretch at most."""
    spark = prepare(conversations.sparkSession)
    scratch = Scratch(spark)
    stretches = stretches_of(conversations, scratch, stretch)

    # The first to say something; all others that say it say it again.
    at = F.struct("block", "seg", "place")
    sayings = stretches.select("conv_id", "block", "seg", F.posexplode("digests").alias("place", "digest")).where("digest IS NOT NULL")
    firsts = sayings.groupBy("conv_id", "digest").agg(F.min(at).alias("at")).select("at.*").groupBy("block", "seg").agg(F.collect_list("place").alias("firsts"))
    marked = stretches.select("conv_id", "block", "seg", "codes").join(firsts, ["block", "seg"], "left")
    found = scratch.save(marked.mapInArrow(_marked, _MATRICES), "matrices")

    # Conversations of several stretches need what lies behind and before each.
    spread = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("block", "seg")).alias("last")).where("n > 1")
    spread = scratch.save(spread.select(F.col("conv_id").alias("c"), "last"), "spread")
    several = scratch.save(found.join(spread, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "block", "seg", "codes", "m", (F.col("last") == F.struct("block", "seg")).alias("last")), "several")
    vectors = scratch.save(behind(several, END), "behind")
    begin = np.array([0, NEVER, NEVER, NEVER], np.int64)
    out = several.select("conv_id", "block", "seg", "codes").join(vectors.drop("conv_id"), ["block", "seg"]).mapInArrow(_exits, "conv_id long, block int, seg int, m array<long>")
    before = behind(scratch.save(out, "exits"), begin).select((-F.col("block")).alias("block"), (-F.col("seg")).alias("seg"), F.col("behind").alias("before"))
    context = vectors.join(before, ["block", "seg"]).join(several.select("block", "seg", "last"), ["block", "seg"]).select("block", "seg", "behind", "before", "last")
    context = scratch.save(context, "context")
    known = found.select("conv_id", "block", "seg", "codes").join(context, ["block", "seg"], "left").withColumn("ends", F.coalesce("last", F.lit(True)))
    edited = scratch.save(known.select("conv_id", "block", "seg", "codes", "behind", "before", "ends").mapInArrow(_edited, _EDITED), "edited")

    alone = context.select("block", "seg", F.lit(False).alias("alone"))
    texts = stretches.select("conv_id", "block", "seg", "roles", "texts").join(edited.drop("conv_id").join(alone, ["block", "seg"], "left"), ["block", "seg"])
    texts = texts.select("conv_id", "block", "seg", F.coalesce("alone", F.lit(True)).alias("alone"), "roles", "texts", "edits", "state")
    lines = scratch.save(texts.mapInArrow(_written, _LINES), "lines")
    hashed = lines.where("NOT alone").select("conv_id", "block", "seg", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "block", "seg").mapInArrow(_hashed, "conv_id long, sha256 string")

    # Neighbours across blocks: a row for each block.
    ends = stretches.select("block", "seg", "conv_id", "codes")
    of_block = ends.groupBy("block").agg(F.min_by(F.struct("conv_id", "codes"), "seg").alias("first"), F.max_by(F.struct("conv_id", "codes"), "seg").alias("last"))
    ahead = F.lag("last").over(Window.orderBy("block"))
    of_block = of_block.select(F.col("first.conv_id").alias("conv_id"), _code(F.col("first.codes"), 1).alias("now"), ahead.alias("ahead"))
    of_block = of_block.where("ahead IS NOT NULL AND ahead.conv_id <=> conv_id").select("conv_id", F.col("now"), _code(F.col("ahead.codes"), -1).alias("then"))
    legal = F.concat(F.col("then"), F.col("now")).isin("12", "23", "32")

    numbers = stretches.select("conv_id", F.explode("turns").alias("turn")).where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = numbers.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))

    # Everything about a conversation, from tables that each have some of it.
    schema = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "part": "struct<block:int,seg:int,edits:string>", "sha256": "string"}

    def some(df: DataFrame, **columns) -> DataFrame:
        return df.select(F.col("conv_id").cast("long").alias("conv_id"), *(columns.get(k, F.lit(None)).cast(v).alias(k) for k, v in schema.items()))

    every = [
        some(gaps, gaps=F.col("gaps")),
        some(found, blank=F.col("blank"), duplicate=F.col("duplicate"), truncated=F.col("truncated")),
        some(stretches, illegal=F.col("illegal")),
        some(of_block, illegal=(~legal).cast("long")),
        some(edited, part=F.struct("block", "seg", "edits")),
        some(lines.where("alone"), sha256=F.col("sha256")),
        some(hashed, sha256=F.col("sha256")),
    ]
    costs = edited.groupBy("conv_id").agg(F.min_by("cost", F.struct("block", "seg")).alias("cost"))
    every.append(some(costs, cost=F.col("cost")))
    if ids is not None:
        every.append(some(ids))
    rows = every[0]
    for x in every[1:]:
        rows = rows.unionByName(x)
    nothing = hashlib.sha256(b"").hexdigest()
    parts = F.array_sort(F.collect_list("part"))
    rows = rows.groupBy("conv_id").agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.array_join(F.transform(parts, lambda x: x["edits"]), "").alias("audit"), F.coalesce(F.max("sha256"), F.lit(nothing)).alias("repaired_sha256"))
    out = scratch.save(rows, "repaired")
    for stays in ("repaired", "lines"):
        scratch.paths.pop(stays)
    scratch.drop(*scratch.paths)
    return Repaired(out, lines.select("conv_id", "block", "seg", "lines"))


def _code(codes, at: int):
    """The initial's code of a stretch's first (1) or last (-1) turn, as a digit."""
    return (F.conv(F.hex(F.substr(codes, F.lit(at), F.lit(1))), 16, 10).cast("int").bitwiseAND(3)).cast("string")

