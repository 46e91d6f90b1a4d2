"""The language-model data operators against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import base64
import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from basketry.llm import _text, chat, decontaminate, exact_dedup, html_extract, near_dedup, packing, sharding, token_count, toxicity, warc

import public_tokenizers as P
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 5))) for _ in range(60)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


BASE = prose(60)
TEXTS = [None, "", " \n", "one", "One", "one two three", BASE, BASE + "\n", BASE.upper(), BASE + " end here", prose(3000), BASE.replace(" ", "  "), "\x0b tab\tx ", "İ ſ 漢字 ’x’"]
TEXTS += [" ".join(w if RNG.random() > 0.02 * (k % 7) else "zz%d" % RNG.randint(0, 99) for w in BASE.split()) for k in range(60)]
SCHEMA = "doc_id long, text string, node long, score double, size string, cluster int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, 0.5, "x", 3) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


def empty(docs):
    return docs.limit(0)


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|> ", "<|endoftext"]
    d = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(list(enumerate(texts))[len(TEXTS) :], "doc_id long, text string"))
    for r in packing.pack(d, P.path("byte_bpe_50k.json"), longest=64).collect():
        got[r.doc_id].append(r)
    plain = packing.Encoder(P.path("byte_bpe_50k.json"), special_as_text=True)
    assert 50256 not in plain.tokenizer.encode(texts[-3], add_special_tokens=False).ids and 50256 in t.encode(texts[-3], add_special_tokens=False).ids
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(got[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.length * 4 == len(r.ids) and r.doc_tokens == len(ids) for r in parts)
    every = [r.sequence_id for rs in got.values() for r in rs]
    assert len(set(every)) == len(every)
    assert packing.pack(empty(docs), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_token_counts(docs, whole):
    from tokenizers import Tokenizer, models, normalizers

    vocabulary = token_count.read_pieces(P.path("piece_bpe_32k.model"))
    vocabulary = vocabulary if whole else [(p, s / 7) for p, s in vocabulary if p not in ("é",)]
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, vocabulary).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(TEXTS)}


PAGE = '<html><body><nav class="n"><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>T{0} &amp; co</h1><p>First\n  {0}<br>line<p><b>Second &lt;{0}&gt;</b></p><div class="comments"><p>me too</p></div><script>var t="</p>";</script><form>q</form><p>Same words</p></article><footer>&copy;</footer></body></html>'


def test_html(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(12)] + [(20, None, None), (21, "http://x.example/", ""), (22, "http://x.example/a", "<p>only &am <b>this"), (23, "http://one.example", PAGE.format("z"))]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i].text == f"T{i} & co\nFirst {i} line\nSecond <{i}>" and got[i].template_pages == 12
    assert [got[i].text for i in (20, 21, 22)] == ["", "", html.unescape("only &am this")]
    assert got[23].text == "Tz & co\nFirst z line\nSecond <z>\nSame words"


def extracted(spark, rows, **options):
    return {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_html_of_copies(spark):
    copies = [(i, None, "<p>one</p><p>two</p>") for i in range(12)] + [(20 + i, f"http://two.example/{i}", f"<p>Page {i % 2}</p><p>more {i % 2}</p>") for i in range(24)]
    got = extracted(spark, copies + [(9, None, "<p>one</p><p>two</p>")])
    assert all(got[i].text == "one\ntwo" and got[i].template_pages == 0 for i in range(12))
    assert all(got[20 + i].text == f"Page {i % 2}\nmore {i % 2}" for i in range(24))


def test_html_keeps_what_every_article_carries(spark):
    got = extracted(spark, [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(12)], keep_article=True)
    assert all(got[i].text == f"T{i} & co\nFirst {i} line\nSecond <{i}>\nSame words" for i in range(12))


UNMARKED = '<body><article><h1><a href="/{0}">Title {0}</a></h1><p>Own <a href="/x">words</a> of {0}</p><section><h4>{1}</h4><ul>{2}</ul></section></article><section><ol>{3}</ol></section></body>'


def links(*names):
    return "".join(f'<li><a href="/{x}">{x}</a></li>' for x in names)


def test_html_finds_unmarked_menus_by_their_slots(spark):
    """A list of links that every page has within its article, by no telling name: the host's template says that it is a menu. Its heading is one block of words and stays, as the title does, which is a link."""
    page = lambda k: UNMARKED.format(k, f"Part {k}", links(*(f"other {k}.{j}" for j in range(2 + k % 3))), links("Home", "About"))
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)]
    got = extracted(spark, rows, keep_article=True)
    assert all(got[k].text == f"Title {k}\nOwn words of {k}\nPart {k}" for k in range(12))
    # Each on a host of its own, nothing is deduced, and the article is taken whole.
    alone = extracted(spark, [(k, f"http://h{k}.example/", text) for k, _, text in rows], keep_article=True)
    assert all(alone[k].text.startswith(f"Title {k}\nOwn words of {k}\nPart {k}\nother {k}.0\nother {k}.1") for k in range(12))


def test_html_keeps_lists_of_words_in_articles(spark):
    """Links in prose, lists of words and one linked block a page are no menus."""
    item = '<li>Point {0}.{1} with <a href="/{1}">a link</a> and more words</li>'
    rows = [(k, f"http://h.example/{k}", '<body><article><p><a href="/a">By A</a></p><ul>' + "".join(item.format(k, j) for j in range(3)) + "</ul></article></body>") for k in range(6)]
    got = extracted(spark, rows, keep_article=True)
    assert all(got[k].text == "By A\n" + "\n".join(f"Point {k}.{j} with a link and more words" for j in range(3)) for k in range(6))


def test_html_menus_against_brute_force(spark):
    """Which elements have a menu behind them, counted over all pages of a host at once."""
    from basketry.llm import _spark

    rows = [(k, f"http://h.example/{k}", UNMARKED.format(k, f"Part {k}", links(*(f"other {k}.{j}" for j in range(k % 4))), links("Home", "About"))) for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host")
    scratch = _spark.Scratch(_spark.prepare(spark))
    parsed = scratch.save(html_extract.parsed(pages), "parsed")
    valid = html_extract.templates(parsed, scratch)
    found = html_extract.with_menus(parsed, valid).collect()
    classes = [r.asDict() for r in found]
    of, sizes = html_extract.elements_of(classes)
    sums = {}
    for _, _, text in rows:
        page = html_extract.Page(text)
        slot = html_extract.slots(page.tokens, of, sizes)
        for place, x, n in zip(page.places, page.texts, page.links):
            sums.setdefault(slot[place], []).append((text, len(x), n))
    want = {s for s, own in sums.items() if s[0] >= 0 and 100 * sum(x[2] for x in own) >= 80 * sum(x[1] for x in own) and len(own) >= 2 * len({x[0] for x in own}) and len({x[0] for x in own}) >= 2}
    assert {(k, t) for k, c in enumerate(classes) for t in c["menus"] or []} == want and want


def test_html_of_two_layouts(spark):
    one = '<body><div class="a"><div class="b"><div class="c">Top of one</div><p>Own {0}</p></div></div></body>'
    two = '<body><section class="d"><table><tr><td>Top of two</td></tr></table><p>Own {0}</p></section></body>'
    rows = [(i, f"http://h.example/{i}", (one if i < 12 else two).format(i)) for i in range(24)]
    # Two pages that quote each other have no layout of their own.
    rows += [(30 + i, f"http://h.example/q{i}", one.format(f"q{i}").replace("<p>", "<p>Quoted words</p><p>")) for i in range(2)]
    got = extracted(spark, rows)
    assert all(got[i].text == f"Own {i}" for i in range(24))
    assert all(got[30 + i].text == f"Quoted words\nOwn q{i}" for i in range(2))


@pytest.mark.parametrize("n", [2, 9, 10, 40])
def test_html_of_hosts_of_any_size_with_broken_pages(spark, n):
    page = "<body><div><b>Shared top</b></div><p>Own {0}</p><div><i>Shared end</i></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(n)] + [(100, "http://h.example/null", None), (101, "http://h.example/blank", " ")]
    if n >= 10:
        rows.append((102, "http://h.example/cut", "<body><div><b>Shared top</b></div><p>Cut"))
    got = extracted(spark, rows)
    assert all(got[i].text == f"Own {i}" and got[i].template_pages == n + (n >= 10) for i in range(n))
    assert got[100].text == got[101].text == "" and (n < 10 or got[102].text == "Cut")


def test_html_keeps_all_outermost_articles(spark):
    page = '<body><p>Out</p><div class="post"><article class="post"><p>One {0}</p></article><article class="post sticky"><p>Two {0}</p><article>In {0}</article></article></div><main>Three {0}</main></body>'
    marked = '<body><p>Out</p><div class="entry">One {0}</div><div class="entry story">Two {0}</div></body>'
    got = extracted(spark, [(i, f"http://h{i % 2}.example/{i}", (page, marked)[i % 2].format(i)) for i in range(6)] + [(10, "http://x.example", page.format(10))], keep_article=True)
    assert all(got[i].text == (f"One {i}\nTwo {i}" if i % 2 else f"One {i}\nTwo {i}\nIn {i}\nThree {i}") for i in got)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_duplicates(docs):
    sets = [shingles(t, 4) for t in TEXTS]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 4, 80).collect()}
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}
    assert near_dedup.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_at_other_thresholds(spark):
    pairs = [(percent, least) for percent in range(26, 101) for least in [near_dedup.least_collisions(percent)]]
    for percent, least in pairs:
        below = lambda t: sum(math.comb(48, k) * (percent / 100) ** k * (1 - percent / 100) ** (48 - k) for k in range(t))  # noqa: B023, E731
        assert below(least) <= 1e-6 and (least == 48 or below(least + 1) > 1e-6)
    assert dict(pairs)[80] == 24
    for percent in (0, 25, 101):
        with pytest.raises(ValueError):
            near_dedup.least_collisions(percent)
    rows = []
    for n in range(60):  # pairs of 60 and 60 words that share 40: 50 %
        own = [f"{n}x{k}" for k in range(80)]
        rows += [(2 * n, " ".join(own[:60])), (2 * n + 1, " ".join(own[20:]))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 50).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


@pytest.mark.parametrize("support", [0.002, 0.2])
def test_exact_duplicates(docs, support):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in TEXTS]
    groups = defaultdict(list)
    for i, b in enumerate(bare):
        groups[b].append((-len(TEXTS[i] or ""), i))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs, support=support).collect()}
    assert got == {i: (min(groups[b])[1], len(groups[b]), min(groups[b])[1] == i, hashlib.sha256(b.encode()).hexdigest()) for i, b in enumerate(bare)}


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_contamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(3, " ".join(BASE.split()[10:40])), (11, "one two"), (12, None), (5, "Zz1"), (5, prose(12))]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for i, t in enumerate(TEXTS):
        w, hit, names = find(t), set(), set()
        for name, text in items:
            own = find(text)
            m = min(10, len(own))
            windows = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if own else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    names.add(str(name))
        want[i] = (len(w), len(hit), sorted(names))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == want
    clean = {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()}
    assert clean == {i for i, x in want.items() if not x[1]}
    assert all(x[1] == 0 for x in decontaminate.contamination(docs, bench.limit(0)).select("doc_id", "n_hit").collect())


def test_contamination_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    d = spark.createDataFrame([(1, "aa bb cc dd"), (1, "aa bb ee ff"), (1, "aa bb ee ff")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "bb cc dd"), (2, "ee ff"), (3, "other words here")], "item_id long, text string")
    got = sorted((r.n_hit, r["items"]) for r in decontaminate.contamination(d, items).collect())
    assert got == [(2, ["2"]), (2, ["2"]), (3, ["1"])]


def test_sharding(docs):
    rows = sharding.shard(docs, shards=4, slots=64).collect()
    slots, taken = {}, Counter()
    for i, t in enumerate(TEXTS):
        slots.setdefault(t or "", set()).update((r.virtual_slot, r.shard) for r in rows if r.doc_id == i)
    assert all(len(x) == 1 for x in slots.values())
    sums, of = Counter(), {}
    for r in rows:
        sums[r.virtual_slot] += r.size
        of[r.virtual_slot] = r.shard
    for slot in sorted(sums, key=lambda x: (-sums[x], x)):  # the largest slot first, each to the least shard
        taken[of[slot]] += sums[slot]
        assert taken[of[slot]] - sums[slot] == min(taken[s] - (sums[slot] if s == of[slot] else 0) for s in range(4))
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(TEXTS)}
    for s in range(4):
        own = [r.slot for r in rows if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    sizes = {i: 100 + i for i in range(64)}
    first = sharding.SlotMap.balanced(sizes, 4, 64)
    grown = first.rebalanced(sizes, shards=5)
    assert grown.version == 2 and sum(a != b for a, b in zip(first.shard_of, grown.shard_of)) <= 20
    totals = Counter()
    for slot, s in enumerate(grown.shard_of):
        totals[s] += sizes[slot]
    assert max(totals.values()) - min(totals.values()) < 200


def test_sharding_follows_the_kept_map(spark, docs, tmp_path):
    maps = f"file://{tmp_path}/maps"
    assert sharding.SlotMap.read(spark, maps) is None
    rows, first = sharding.placed(docs, 4, 64, maps=maps)
    assert sharding.SlotMap.read(spark, maps) == first
    at = {r.doc_id: r.shard for r in rows.collect()}
    later, followed = sharding.placed(docs, 4, 64, maps=maps)
    assert followed == first and all(at[r.doc_id] == r.shard for r in later.collect())
    grown = sharding.placed(docs, 5, 64, maps=maps)[1]
    assert grown.version == 2 and grown.shards == 5
    assert sharding.SlotMap.read(spark, maps) == grown and sharding.SlotMap.read(spark, maps, 1) == first


def test_a_kept_map_keeps_the_law_when_data_grow(spark, tmp_path):
    """A map of few documents is edited for many, and half a version is passed over."""
    maps = f"file://{tmp_path}/maps"
    (tmp_path / "maps" / "version=1").mkdir(parents=True)
    few = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    many = spark.createDataFrame([(i, f"text {i} " * (1 + i % 9)) for i in range(9000)], "doc_id long, text string")
    first = sharding.placed(few, 10, maps=maps)[1]
    assert first.version == 2 and sharding.SlotMap.read(spark, maps) == first
    rows, grown = sharding.placed(many, 10, maps=maps)
    sizes = [r[0] for r in rows.groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 10
    assert grown.version == 3 and sharding.placed(many, 10, maps=maps)[1] == grown
    with pytest.raises(ValueError):
        sharding.SlotMap.read(spark, maps, 1)


def test_toxicity(spark):
    rng = random.Random(1)
    rows = [(i, ". ".join(prose(8, rng) for _ in range(4)) + (". you utter grobnik" + rng.choice(["", "ling"]) if i % 3 == 0 else "")) for i in range(300)]
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(0, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all((got[i].score >= 0.7) == (i % 3 == 0) for i in range(200, 300))
    worst = got[201]
    assert "grobnik" in rows[201][1][worst.worst_start : worst.worst_end]
    assert got[900].score == got[901].score == 0.0
    assert toxicity.without_toxic(d, model).columns == d.columns
    none = toxicity.fit(d, labels.where("toxic = 0"))
    assert all(r.score < 1e-3 and math.isfinite(r.score) for r in toxicity.score(d, none).collect())


def test_chat(spark):
    rows = [(1, 0, "a", "x"), (1, 1, "b", None), (1, 300, "a", "é"), (1, 300, "a", "é"), (2, None, None, "q"), (None, 5, "b", "w")]
    rows += [(3, None, f"s{k % 3}", f"t{k}") for k in range(40)]
    got = chat.rotate(spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, content string, block int"), blocks=5).collect()
    for conv, perspective in {(r.conv_id, r.perspective) for r in got}:
        own = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, perspective)), key=lambda r: r.start)
        assert [(r.turn is not None, r.turn or 0, r.speaker) for r in own] == sorted((r.turn is not None, r.turn or 0, r.speaker) for r in own)
        whole = "".join(r.rendered for r in own)
        assert [r.position for r in own] == list(range(len(own)))
        for r in own:
            assert whole[r.start : r.end] == r.rendered and r.trained == (r.speaker == perspective)
            assert not r.trained or whole[r.mask_start : r.mask_end].endswith("<|end|>")
    assert len([r for r in got if r.conv_id == 1]) == 8


def test_warc(spark):
    pages = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"page {i} é" * 50) for i in range(40)] + [(50, None, None), (51, "u\r\nv", "")]
    more = [(60, "a", "twice"), (60, "a", "twice"), (59, "b", "twice"), (61, "c", "x"), (61, "c", "y"), (None, "n", "z"), (None, "n", "z"), (None, "m", "same")]
    archive = warc.write_archives(spark.createDataFrame([(*p, 1, "d") for p in pages + more], "page_id long, url string, html string, refers_to int, digest string").repartition(3))
    every = warc.read_archives(spark, archive).collect()
    ids = [r.record_id for r in archive.index.collect()]
    assert len(ids) == len(set(ids)) == len(every) == len(pages) + len(more)
    assert sorted((r.page_id or 0, r.url, r.record_type, r.refers_to) for r in every if r.page_id in (None, 59, 60, 61)) == [
        (0, "m", "revisit", 39), (0, "n", "response", None), (0, "n", "response", None), (59, "b", "revisit", 60), (60, "a", "response", None), (60, "a", "response", None), (61, "c", "response", None), (61, "c", "response", None)
    ]
    assert {r.url for r in every if r.page_id == 51} == {"u\r\nv"}
    got = {r.page_id: r for r in every}
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(i, largest.get(h or "", -1))
    for i, _, h in pages:
        data, top = (h or "").encode(), largest[h or ""]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if top == i else ("revisit", top))
        assert r.payload is None or bytes(r.payload) == data
    row = archive.index.where("page_id = 1").first()
    head, block = warc.read_record(archive, row.bundle, row.frame, row.frame_offset)
    assert head["WARC-Record-ID"] == row.record_id and block.endswith(pages[1][2].encode())
    at = {r.page_id: r for r in archive.index.collect()}
    head, _ = warc.read_record(archive, at[3].bundle, at[3].frame, at[3].frame_offset)
    assert head["WARC-Refers-To"] == at[39].record_id
    small = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), least=10)
    assert {r.record_type for r in warc.read_archives(spark, small).collect()} == {"response"}


def test_words_match_a_regex():
    import pyarrow as pa

    data, off = _text.utf8(pa.array(TEXTS))
    h, at, _, _ = _text.words(data, off, 0, len(TEXTS), _text.NOT_SPACE)
    seen = {}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert len(w) == at[i + 1] - at[i]
        for x, v in zip(w, h[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(x, v) == v
    assert len(set(seen.values())) == len(seen)


def counted(rows):
    return Counter((r.doc_id, r.text) for r in rows)


ROWS = [(1, "a  b"), (1, "a  b"), (2, "a b"), (None, "c"), (None, "c"), (None, "d e"), (3, "d  e"), (4, "c d"), (4, "x y"), (None, None), (None, ""), (5, "d e")]


def test_exact_stage_decides_by_row(spark):
    import corpus_pipeline

    groups = defaultdict(list)
    for i, t in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i, t))
    got = counted(corpus_pipeline.remove_exact_copies(spark, spark.createDataFrame(ROWS, "doc_id long, text string"), "").collect())
    assert Counter({(i, t or ""): n for (i, t), n in got.items()}) == Counter((b[3], b[4] or "") for b in (min(g, key=lambda x: x[:3]) for g in groups.values()))


def test_near_stage_decides_by_row(spark):
    import corpus_pipeline

    words = ["w%d" % i for i in range(200)]
    text = " ".join(words)
    near, other = text + " more", prose(90, random.Random(8))
    rows = [(7, text), (3, near), (3, other), (None, text + " last"), (None, prose(80, random.Random(9))), (9, other), (9, other), (None, "q w e r t y u i"), (None, "q w e r t y u i"), (11, None), (11, "")]
    got = counted(corpus_pipeline.remove_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == Counter([(3, near), (3, other), rows[4], rows[7], rows[9], rows[10]])


def test_pipeline_against_brute_force(spark):
    """Scores are learned, so the fitted model's are taken; what the stages make of them and of the texts is worked out anew."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(documents, spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out("doc_id")), label_column="toxic")
    clean = {r.doc_id for r in toxicity.score(documents, model).collect() if r.score < 0.7}
    docs = {r.doc_id: r.text for r in documents.collect() if r.doc_id in clean}

    same = defaultdict(list)
    for i, t in docs.items():
        same[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    docs = {i: docs[i] for i in sorted(min(g)[1] for g in same.values())}

    sets = {i: shingles(t, 5) for i, t in docs.items()}
    label = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    docs = {i: t for i, t in docs.items() if label[i] == i}

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    spans = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = find(r.text)
        if w:
            windows[min(10, len(w))] |= spans(w, min(10, len(w)))
    docs = {i: t for i, t in docs.items() if not any(spans(find(t), n) & found for n, found in windows.items())}

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id].append((r.start, r.ids))
    assert 0 < len(docs) < documents.count()
    assert {i: b"".join(ids for _, ids in sorted(parts)) for i, parts in got.items()} == {
        i: b"".join(x.to_bytes(4, "little") for x in [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in docs.items()
    }


@pytest.mark.parametrize("mark, goes", [(x, True) for x in ("article-comments", "user-comments", "comment-list", "related-posts", "related articles-box", "social-media", "cookie-policy", "share-buttons", "newsletter-signup")] + [(x, False) for x in ("post-body", "media-content", "privacy-policy", "entry-title", "links-text", "user-guide", "comment-on-budget")])
def test_html_marks_within_articles(mark, goes):
    page = html_extract.Page(f'<article><p>First words.</p><div class="x {mark}"><p>Second words.</p></div><p>Third words.</p></article>')
    assert [t for t in page.texts if t] == ["First words.", *([] if goes else ["Second words."]), "Third words."]
