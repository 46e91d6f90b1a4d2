"""Line deduplication, repair of conversations and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from basketry.llm import _text, line_dedup, queries, repair, spelling

WS = " \t\n\x0b\x0c\r"
SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


# Lines


def key(line):
    return line.strip(WS).translate(LOWER)


def lines_by_hand(rows, least_length=20, least_documents=3):
    held = defaultdict(set)
    for i, (d, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            held[key(line)].add((-1 if d is None else d, i))
    stays = {k: max(v)[0] for k, v in held.items() if len(k) >= least_length and len(v) >= least_documents}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if stays.get(key(x), d) in (d, -1 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def odd_documents(rng):
    shared = ["A line that many documents share", "  İt has  spaces and é accents \t", "nineteen code point", "exactly twenty point", "é" * 20, "x" * (2 * _text.SLICE), "twice only, so it stays in both"]
    rows = [(None, None), (None, ""), (0, "\n\n"), (1, " \x0b ")]
    for i in range(40):
        lines = [rng.choice(shared[:-1] if rng.random() < 0.5 else [f"a line of its own {rng.random()}", "short", "", shared[0].upper(), shared[1] + " "]) for _ in range(rng.randint(1, 9))]
        rows.append((rng.choice([i, i, i, 7, None]), "\n".join(x if len(x) < 99 or i % 9 == 0 else "" for x in lines)))
    return [*rows, rows[-1], (50, shared[-1]), (51, shared[-1]), (60, "\n".join(f"line number {k} of a long text" for k in range(60000)))]


def documents_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", b"y", [2]) for i, t in rows], "doc_id long, text string, lines int, text_hash string, digest binary, lost array<int>").repartition(5)


@pytest.mark.parametrize("most_bits", [line_dedup.MOST_BITS, line_dedup.PART_BITS])
def test_lines_by_hand(spark, most_bits):
    rows = odd_documents(random.Random(2))
    got = [tuple(r) for r in line_dedup.line_duplicates(documents_of(spark, rows), most_bits=most_bits).collect()]
    assert Counter(got) == Counter(lines_by_hand(rows))
    assert sum(r[2] for r in got) > 10


def test_lines_of_null_ids_and_no_rows(spark):
    rows = [(None, "a line that many documents share")] * 5
    assert {tuple(r) for r in line_dedup.line_duplicates(documents_of(spark, rows)).collect()} == {(None, 1, 0, rows[0][1])}
    assert line_dedup.line_duplicates(documents_of(spark, rows).limit(0)).count() == 0


def test_lines_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", 3)
    rows = odd_documents(random.Random(4))
    assert Counter(tuple(r) for r in line_dedup.line_duplicates(documents_of(spark, rows)).collect()) == Counter(lines_by_hand(rows))


def test_filters_find_all_that_comes_twice():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    tasks = [h[:3000], h[2000:4000], h[4000:]]
    merged = np.zeros((2, 1 << 13), np.uint8)
    for own in tasks:
        once, twice = np.zeros((2, 1 << 13), np.uint8)
        line_dedup.meet(once, twice, np.arange(len(own) + 10), np.concatenate([own, own[:10]]))
        merged[1] |= twice | (merged[0] & once)
        merged[0] |= once
    known = line_dedup.knows(merged[1], line_dedup.places(h, 1 << 16))
    assert known[2000:3000].all() and known[:10].all() and known[4000:4010].all()
    assert known[10:2000].mean() < 0.2


def test_line_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.execute(queries.ORACLE["op11_line_dedup"]).fetchall()}
    assert {tuple(r) for r in queries.op11_line_dedup(spark, SF).collect()} == want


# Turns

COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def damaged(rows):
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        yield from [(c, t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1)


def cheapest(rows):
    """Best (cost, edits, lines) to have used i turns and end with a role, by trying every edit."""
    faults, seen = [], set()
    for _, r, x in rows:
        faults.append("blank" if not x.strip(WS) else "again" if (r, x) in seen else "" if x.rstrip(WS)[-1] in ".!?" else "broken")
        seen.add((r, x))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(0, ""): (0, "", ())}

    def offer(at, cost, edits, lines):
        if at not in best or (cost, edits) < best[at][:2]:
            best[at] = cost, edits, lines

    for i in range(len(rows) + 1):
        for q in list(follows) * 4:
            for role in ("user", "assistant"):
                if (i, q) in best and role[0] in follows[q]:
                    cost, edits, lines = best[i, q]
                    offer((i, role[0]), cost + 5, edits + "I", (*lines, f"{role}:"))
        for q in follows:
            if i < len(rows) and (i, q) in best:
                (_, r, x), (cost, edits, lines) = rows[i], best[i, q]
                offer((i + 1, q), cost + 2, edits + "D", lines)
                more = 5 * (faults[i] == "broken")
                if faults[i] not in ("blank", "again"):
                    for role, price, e in ((r, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                        if role and role[0] in follows[q]:
                            offer((i + 1, role[0]), cost + price + more, edits + e, (*lines, f"{role}:{x}"))
    cost, edits, lines = min((best[len(rows), q] for q in ("", "a") if (len(rows), q) in best), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    wrong = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, faults.count("blank"), faults.count("again"), faults.count("broken"), wrong, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def turns_by_hand(rows, ids):
    own = defaultdict(list)
    for c, *turn in rows:
        own[c].append([turn[0], *(" " if v is None else v for v in turn[1:])])
    return {(c, *cheapest(sorted(own[c], key=lambda v: (v[0] is not None, v[0] or 0)))) for c in ids}


def odd_turns(rng):
    rows = {}
    for c in [None, *range(40)]:
        for i in range(900 if c == 7 else rng.choice([0, 1, 2, 3, 5, 9, 30])):
            t = None if i == 3 else i * rng.choice([1, 1, 1, 2])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "u", "agent"])
            text = rng.choice(["Hi there.", "What?", "no end", " ", "", None, "é!\x0b\n", *(f"{x} {rng.randint(0, 9999)}{x}" for x in ".!?,")])
            rows[c, t] = (c, t, role, text)
    return list(rows.values())


@pytest.mark.parametrize("stretch", [1, 4, 256])
def test_turns_by_hand(spark, stretch):
    rows = odd_turns(random.Random(stretch))
    df = spark.createDataFrame([(*r, 1, b"x", 2) for r in rows], "conv_id long, turn long, role string, text string, block int, codes binary, seg int").repartition(3)
    ids = {r[0] for r in rows} | {99}
    got = repair.repair(df, spark.createDataFrame([(99,)], "conv_id long"), stretch)
    want = turns_by_hand(rows, ids)
    assert {tuple(r) for r in got.conversations.select(COLUMNS).collect()} == want
    lines = defaultdict(list)
    for r in sorted(got.turns.collect(), key=lambda r: (r.block, r.seg)):
        lines[r.conv_id] += r.lines
    assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in ids} == {r[0]: r[-1] for r in want}


def test_repeated_turns_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hello."), (1, 1, "user", "Hello."), (1, None, "system", "Be kind."), (1, 2, "assistant", "Hi.")], "conv_id long, turn long, role string, text string")
    (r,) = repair.repair(df.repartition(3)).conversations.collect()
    assert (r.duplicate, r.cost, r.audit, r.gaps, r.illegal) == (1, 2, "KKDK", 0, 1)
    assert repair.repair(df.limit(0)).conversations.count() == 0


def test_repair_query(spark):
    rows = rows_of(spark, "conversations", "conv_id", "turn", "role", "text")
    want = turns_by_hand(list(damaged(rows)), {r[0] for r in rows})
    assert {tuple(r) for r in queries.op12_conversation_repair(spark, SF).select(COLUMNS).collect()} == want


# Words


def variants_by_hand(n, times=10):
    letters, near = sorted({x for w in n for x in w}), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            for v in {w[:i] + w[i + 1 :], *(w[:i] + x + w[i + 1 :] for x in letters)} - {w}:
                if v in n:
                    near[w].add(v)
                    near[v].add(w)
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


WORDS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_by_hand(spark):
    rng = random.Random(6)
    n = {"aaaaaaaa": 5, "aaaaaaa": 50, "aaaaaab": 500, "aaaaab": 5000, "a" * 3000: 1, "a" * 2999 + "b": 10, "a" * 2999: 100, "𝒜bc": 1, "𝒜b": 10, "bc": 100, "x": 3, "": 9}
    for _ in range(600):
        n["".join(rng.choice("abé") for _ in range(rng.randint(4, 8)))] = rng.choice([1, 2, 10, 20, 100, 1000, 10000])
    df = spark.createDataFrame([(w, c, 1, "x", 2) for w, c in n.items()], "word string, n long, id int, key string, place int").repartition(3)
    assert {tuple(r) for r in spelling.variants(df).select(WORDS).collect()} == variants_by_hand(n)
    assert spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, times=1)


def test_collisions_make_no_pairs():
    """Rows whose keys meet are still compared by their strings."""
    key = np.zeros(6, np.int64)
    place, last = np.array([-1, 0, 0, 1, 1, 2], np.int32), np.array([0, 1, 1, 1, 0, 1], bool)
    replaced, longer = spelling.meeting(key, place, last)
    assert replaced.tolist() == [False, True, True, True, True, False] and longer.tolist() == [True, True, True, True, False, True]
    words = ["banana", "bananas", "cabana"]
    keys, owner, at, _ = spelling.deletion_keys(words)
    strings = [words[o] if p < 0 else words[o][:p] + words[o][p + 1 :] for o, p in zip(owner, at)]
    assert len(set(zip(strings, keys.tolist()))) == len(set(strings)) == len(set(keys.tolist()))


def test_spelling_query(spark):
    n = Counter()
    for d, text in rows_of(spark, "documents", "doc_id", "text"):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = variants_by_hand({w: c for w, c in n.items() if len(w) >= 7 and c >= 2})
    assert {tuple(r) for r in queries.op13_spelling_variants(spark, SF).select(WORDS).collect()} == want


def test_words_of_odd_documents(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "Straße STRASSE straße"), (1, "straße"), (None, "ÀÉ àé")], "doc_id long, text string")
    assert {tuple(r) for r in spelling.word_counts(df, shortest=2, least=1).collect()} == {("straße", 3), ("strasse", 1), ("ÀÉ", 1), ("àé", 1)}


