"""Cases that every operator has to stand: empty tables, null and repeated ids, repeated rows, clashing columns, texts larger than a slice; and the queries' digests against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.llm import _text, chat, decontaminate, exact_dedup, html_extract, near_dedup, packing, queries, sharding, token_count, toxicity, warc

import public_tokenizers as P

RNG = random.Random(11)
WORDS = ["w%x" % RNG.randrange(1 << 30) for _ in range(300)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(300_000))
NEAR = LONG[:-40] + "other words at the end of it"
SF = "/root/testdata/sf0.001"
VOCABULARY = [("<unk>", 0.0), ("▁", -1.0), ("w", -1.0), ("▁w", -2.0), *((c, -2.0) for c in "0123456789abcdefo")]


def docs_of(spark, rows):
    """Rows (doc_id, text) with columns whose names operators use themselves."""
    columns = "doc_id long, text string, node long, component string, hash int, item_id string, slot int, shard string, row_key int, page_id int, kept string, score string"
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3, "z", 4, 5, "k", "s") for i, t in rows], columns)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, ids shared by different texts, repeated rows, null and empty texts, texts larger than a slice."""
    assert len(LONG) > 2 * _text.SLICE
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, None), (1, "f g h i j k"), (1, "f g h i j k"), (1, "quite other words here"), (2, ""), (3, None), (4, LONG), (5, NEAR), (6, "quite other words here")]
    return rows, docs_of(spark, rows).repartition(2).cache()


def test_empty_tables(spark):
    none = docs_of(spark, []).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert token_count.count_tokens(none, VOCABULARY).count() == 0
    assert html_extract.extract(pages).count() == 0
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert decontaminate.contamination(none, none).count() == decontaminate.decontaminated(none, none).count() == 0
    assert sharding.shard(none, 4, 16).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    archive = warc.write_archives(pages)
    assert warc.read_archives(spark, archive).count() == archive.index.count() == 0


def test_packing_of_odd_rows(odd):
    from tokenizers import Tokenizer

    rows, df = odd
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = Counter()
    parts = defaultdict(list)
    for r in packing.pack(df, P.path("byte_bpe_50k.json")).collect():
        parts[r.doc_id, r.doc_tokens].append(r)
        got[r.doc_id, r.doc_tokens, r.start, r.length] += 1
    for (i, text), n in Counter(rows).items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = {(r.start, bytes(r.ids)) for r in parts[i, len(ids)]}
        whole = b"".join(x.to_bytes(4, "little") for x in ids)
        found = [s for s in own if whole[4 * s[0] : 4 * s[0] + len(s[1])] == s[1]]
        assert sum(len(s[1]) for s in found) >= len(whole)
        assert all(c % n == 0 or text != rows[0][1] for k, c in got.items() if k[:2] == (i, len(ids)))


def test_counts_and_signatures_of_odd_rows(odd):
    rows, df = odd
    counter = token_count.Counter(VOCABULARY)
    got = Counter((r.doc_id, r.n_chars, r.n_tokens, r.best_score) for r in token_count.count_tokens(df, VOCABULARY).collect())
    assert got == Counter((i, len(t or ""), *counter.whole(t or "")) for i, t in rows)


def test_near_duplicates_of_odd_rows(odd):
    rows, df = odd
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 3, 80).collect())
    words = [(t or "").split() for _, t in rows]
    sizes = [len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) if w else 0 for w in words]
    # Texts of null ids have no links; id 1 has two texts and so ties what either is linked to; the long texts are near copies.
    name = {1: 1, 6: 1, 4: 4, 5: 4}
    assert got == Counter((i, n, name.get(i, i), name.get(i, i) == i) for (i, _), n in zip(rows, sizes))


@pytest.mark.parametrize("short, block", [(64, 2048), (4, 16)])
def test_near_duplicates_in_a_large_group(spark, monkeypatch, short, block):
    """Near copies of one text, most alike, some only of each other, some of none, and two chains; against brute force."""
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rng, base = random.Random(3), [f"b{k}" for k in range(120)]
    texts = []
    for n in range(300):
        share = (0.02, 0.06, 0.12, 0.2)[n % 4]
        texts.append(" ".join(f"x{n}_{k}" if rng.random() < share else w for k, w in enumerate(base)))
    for c in range(2):
        now = [f"c{c}_{k}" for k in range(100)]
        for step in range(12):
            now = [f"c{c}_{k}_{step}" if k // 8 == step else w for k, w in enumerate(now)]
            texts.append(" ".join(now))
    sets = [{tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for t in texts]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: root(i) for i in range(len(sets))}
    assert 1 < len(set(got.values())) < len(got)


def test_exact_duplicates_of_odd_rows(spark, odd):
    rows, df = odd
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[bare], key=lambda x: x[:3])[3]
        want[i, keep, len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(df).collect()) == want
    least = spark.createDataFrame([(-(1 << 63), "a"), (5, "a"), ((1 << 63) - 1, "a")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.exact_duplicates(least).collect()} == {-(1 << 63)}


@pytest.mark.parametrize("block", [1 << 24, 8])
def test_contamination_of_odd_rows(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows, df = odd
    words = LONG.split()
    items = [(7, " ".join(words[200_000:200_020])), (7, "quite other"), (None, "f g h"), (8, None)]
    bench = spark.createDataFrame([(i, t, "d", 1) for i, t in items], "item_id long, text string, doc_id string, hash int")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(df, bench).collect())
    want = Counter()
    for i, t in rows:
        w = (t or "").split()
        hit = 20 if t in (LONG, NEAR) else 3 if t and t.startswith("f g") else 2 if t and t.startswith("quite") else 0
        want[i, len(w), hit, ("",) if hit == 3 else ("7",) if hit else ()] += 1
    assert got == want
    clean = decontaminate.decontaminated(df, bench)
    assert clean.columns == df.columns and Counter(r.doc_id for r in clean.collect()) == Counter([None, None, None, 2, 3])


def test_sharding_of_odd_rows(odd):
    rows, df = odd
    got = sharding.shard(df, 3, 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.text_crc32 for r in got}) == len({(r.text_crc32, r.shard) for r in got})


def test_a_grown_map_moves_slots_alone(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i % 50} " * (i % 7)) for i in range(400)], "doc_id long, text string")
    maps = f"file://{tmp_path}/maps"
    first, one = sharding.placed(d, 4, 64, maps=maps)
    before = {(r.doc_id, r.virtual_slot): r.shard for r in first.collect()}
    later, two = sharding.placed(d, 5, 64, maps=maps)
    after = {(r.doc_id, r.virtual_slot): r.shard for r in later.collect()}
    moved = {x for x in range(64) if one.shard_of[x] != two.shard_of[x]}
    assert moved and before.keys() == after.keys()
    assert all((before[k] != after[k]) == (k[1] in moved) for k in before)


def test_toxicity_of_odd_rows(spark, odd):
    rows, df = odd
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(100, 160)] + [(100, 0), (1, None), (1, 0), (5, 0)], "doc_id long, toxic int")
    learned = docs_of(spark, [(i, f"plain words n{i} here. " + ("you grobnik. and grobnik" if i % 2 else "kind words")) for i in range(100, 160)] * 2)
    both = df.unionByName(learned)
    model = toxicity.fit(both, labels)
    got = toxicity.score(both, model).collect()
    assert len(got) == len(rows) + 120 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    tie = next(r for r in got if r.doc_id == 101)
    text = "plain words n101 here. you grobnik. and grobnik"
    assert text[tie.worst_start : tie.worst_end] == "you grobnik"
    assert {r.score for r in got if r.doc_id == 3} == {0.0}


def test_toxicity_against_a_plain_scorer(spark):
    """The noisy-or of a model's sentences, worked out sentence by sentence."""
    import math

    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    texts = [". ".join(" ".join(rng.choice(WORDS[:40]) for _ in range(6)) for _ in range(rng.randint(1, 5))) for _ in range(200)]
    texts = [t + (". éà %s %s" % (WORDS[50], WORDS[51]) if k % 3 == 0 else "") for k, t in enumerate(texts)]
    model = toxicity.learn(np.array([int(k % 3 == 0) for k in range(200)]), pa.array(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for k, t in enumerate(texts):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", t):
            if re.search(r"\w", sentence):
                data, off = _text.utf8(pa.array([sentence]))
                held = set()
                for word, h in toxicity._sentences(data, off, 0, 1)[2]:
                    held.update(model.find(h)[1].tolist())
                clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights[f] for f in held))))
        assert got[k].score == pytest.approx(1 - clean, abs=1e-9)


SNIPPETS = [
    ("<p>Hello <script>x()</script>world</p>", "Hello world"),
    ("<p>a<svg><g><svg></svg>x</g></svg>b</p><svg/>c", "ab\nc"),
    ('<article><div class="market-share">a</div><p class="notice-board">b</p><div class="share buttons">c</div></article>', "a\nb"),
    ('<div class="story x1">one</div><div class="story y">two</div>', "one\ntwo"),
    ('<article><p>Text <button>Share</button>and <span class="ad">Buy now</span> more</p><div class="paywall-teaser">p</div><div class="gdpr">g</div></article>', "Text and more"),
    ("<div>" * 60 + "<article>deep</article><p>side</p>" + "</div>" * 60, "deep"),
    ("<article>x<title>t", "x"),
    ('<nav>n</nav><p>1 &lt; 2 &amp;c</p><ul><li><a href="/">Home</a><li><a href="/b">Buy</a></ul>', "1 < 2 &c\nHome\nBuy"),
    ("<p>one<p>two<br>three", "one\ntwo three"),
]


def test_html_snippets(spark):
    rows = [(k, f"http://s{k}.example/", html) for k, (html, _) in enumerate(SNIPPETS)] * 2
    df = spark.createDataFrame([(*r, "h", "t", 1) for r in rows], "page_id long, url string, html string, host string, tokens string, classes int")
    got = Counter((r.page_id, r.text) for r in html_extract.extract(df, keep_article=True).collect())
    assert got == Counter((k, text) for k, (_, text) in enumerate(SNIPPETS) for _ in range(2))


def test_html_deduction_against_brute_force(spark):
    """Classes by whole vectors, their order and nesting looked at page by page, on a host of two layouts."""
    rng = random.Random(4)
    pages = []
    for k in range(30):
        items = "".join(f"<li><b>Item</b> {k}.{j}</li>" for j in range(rng.randint(1, 4)))
        first = f"<div class=top><h2>Site</h2><p>Motto</p></div><section><h3>About {k}</h3><ul>{items}</ul></section><div class=end><p>All rights</p><p>Ours</p></div>"
        second = f"<table><tr><td>Left<td>Own {k}</table><dl><dt>Key<dd>Value {k}</dl>"
        pages.append("<body>" + (first if k % 3 else second) + "</body>")
    parsed = [html_extract.Page(p) for p in pages]
    vectors = defaultdict(list)
    for token in {t for p in parsed for t in p.tokens}:
        vectors[tuple(p.tokens.count(token) for p in parsed)].append(token)
    classes = []
    for vector, tokens in vectors.items():
        on = [k for k, n in enumerate(vector) if n]
        if len(on) >= 2 and (sum(t % 2 == 0 for t in tokens) >= 3 or 100 * len(on) >= 90 * len(pages)):
            classes.append((tuple(sorted(tokens)), on))
    valid = set()
    for tokens, on in classes:
        orders = Counter()
        for k in on:
            own = [t for t in parsed[k].tokens if t in tokens]
            rounds = [tuple(own[i : i + len(tokens)]) for i in range(0, len(own), len(tokens))]
            # Between a round's first and last token, no other class may begin without ending or end without beginning.
            ends, good = [], len(set(rounds)) == 1 and len(own) % len(tokens) == 0
            places = [i for i, t in enumerate(parsed[k].tokens) if t in tokens]
            for i in range(0, len(places), len(tokens)):
                ends.append((places[i], places[i + len(tokens) - 1]))
            for other, _ in classes:
                if other != tokens:
                    there = [i for i, t in enumerate(parsed[k].tokens) if t in other]
                    gaps = [sum(p <= x for p in places) for x in there]
                    within = {g for g in gaps if g % len(tokens)}
                    if within and len(there) >= len(other):
                        for g in within:
                            good = good and sum(x == g for x in gaps) % len(other) == 0 or len(other) > len(tokens)
            orders[rounds[0] if good else None] += 1
        orders.pop(None, None)
        if orders and 100 * max(orders.values()) >= 90 * len(on):
            valid.add(tokens)
    df = spark.createDataFrame([("h", k, __import__("numpy").array(p.tokens, "<i8").tobytes()) for k, p in enumerate(parsed)], "host string, digest long, tokens binary")
    from basketry.llm._spark import Scratch, prepare

    found = {tuple(sorted(r.tokens)) for r in html_extract.templates(df, Scratch(prepare(spark))).collect()}
    assert found == valid and len(found) > 2
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame([(k, f"http://h/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    words = {t for c in valid for t in c if t % 2}
    assert got == {k: "\n".join(x for x, place in zip(p.texts, p.places) if p.tokens[place] not in words) for k, p in enumerate(parsed)}
    assert not any("Motto" in t or "All rights" in t or t.startswith("Left") for t in got.values())


def test_query_digests(spark):
    """The queries' columns on sf0.001, against the texts."""
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
    for r in queries.op1_packing(spark, SF).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own[r.start : r.start + r.length]))
    find = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = find(r.text)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(str(r.item_id))
    lengths = {len(w) for w in windows}
    for r in queries.op6_decontamination(spark, SF).collect():
        w, hit, names = find(texts[r.doc_id]), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    names |= own
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    shards = queries.op7_sharding(spark, SF).collect()
    assert {r.law for r in shards} == {"bytes"} and {r.grown_shard for r in shards} == {None} and len(shards) == len(texts)
    for r in queries.op8_toxicity(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    pages = {r.page_id: r for r in queries.op10_warc(spark, SF).collect()}
    assert len(pages) == spark.read.parquet(f"{SF}/pages.parquet").count()
    for r in queries.op3_html_extraction(spark, SF).collect():
        assert r.n_chars == len(r.text)


def test_pipeline_stages_of_odd_rows(spark, odd):
    import corpus_pipeline

    rows, df = odd
    none = df.limit(0)
    for stage in (corpus_pipeline.remove_exact_copies, corpus_pipeline.remove_near_copies, lambda *a: corpus_pipeline.remove_toxic(a[0], a[1], SF), lambda *a: corpus_pipeline.remove_benchmark(a[0], a[1], SF)):
        assert stage(spark, none, SF).columns == df.columns and stage(spark, none, SF).count() == 0
    exact = corpus_pipeline.remove_exact_copies(spark, df, SF)
    assert exact.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in exact.collect()) == Counter([(None, "a b c d e"), (1, "f g h i j k"), (1, "quite other words here"), (2, ""), (4, LONG), (5, NEAR)])
    near = corpus_pipeline.remove_near_copies(spark, exact, SF)
    assert near.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in near.collect()) == Counter([(None, "a b c d e"), (1, "f g h i j k"), (1, "quite other words here"), (2, ""), (4, LONG)])
    assert corpus_pipeline.remove_toxic(spark, df, SF).columns == df.columns
    assert corpus_pipeline.remove_benchmark(spark, df, SF).count() == len(rows)
    assert corpus_pipeline.pack(spark, none, SF).count() == 0 and corpus_pipeline.pack(spark, df.where(F.col("doc_id") < 4), SF).select("doc_id").distinct().count() == 3
