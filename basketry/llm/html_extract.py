"""Main text by template deduction from equivalence classes.

A page is parsed once, into tokens in their order: the opening tags of its elements, each
with its path of open elements, and its blocks of text, each with its path. Then, for the
pages of a host:

1. A token's occurrence vector says how often it is on each page. Tokens that share a
   vector are a class, whether they stand once on a page or repeat. Vectors are compared by
   fingerprints that are combined page by page, so no list of pages is ever gathered and a
   host with any share of all pages is pre-aggregated like any other.
2. Large and frequent classes are looked at: on two pages and on SUPPORT of a hundred of the
   host's pages or more, and with LEAST_ELEMENTS elements or on MOST_PAGES of a hundred. So
   classes of text alone, as pages that quote each other have, don't count, and what is
   known of a host is bounded by 100 / SUPPORT times the tokens of a page.
3. A class is valid if on MOST_PAGES of a hundred of its pages its tokens come in one order,
   over and over, and it nests: a class that begins within another one ends before the
   other's next token. Valid classes make up the host's template, nested as they stand.
4. What a page has between the elements of its template are slots. A slot is known by the
   class within which it is and the element before it. Blocks in valid classes are the
   template's own words; they stand in slots like others.
5. Slots are looked at over all pages of the host: a slot in which nearly all the text is
   links (MENU_LINKS of a hundred characters), with MENU_BLOCKS blocks a page or more, is a
   menu, whatever its elements are called and wherever it stands, articles included.

The main text of a page is what its slots hold that aren't menus: of pages with articles
(elements that say by name or role that they are an article or the main part), the slots'
blocks within these; of others, the blocks that aren't the template's words, but for slots
in which most of the page's text is links; if some of its elements are marked as content,
only those. Elements that are boilerplate by name, role or mark (a mark counts if it has no
other words than such ones and general ones) have no text anywhere.

Null and empty html give an empty text. Cut-off markup is closed at its end. Repeated rows,
rows that share an id and copies are extracted each, but a template is deduced from the
distinct contents of a host's pages: copies count once, and pages without tokens don't.
Null urls are one host. The rule is the same for every host of two pages or more; on a host
of one page all text is a slot's. A token that two classes could claim has one vector, so
there are no ties. Pages of any length and depth are taken whole; an empty table gives an
empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._spark import Scratch, prepare

#: Distinct pages that a class needs, and of a hundred of the host's how many.
LEAST_PAGES, SUPPORT = 2, 1
#: Elements that a class needs, and of a hundred of the host's pages how many make up for them.
LEAST_ELEMENTS, MOST_PAGES = 3, 90
#: Characters in links, of a hundred, and blocks a page that make a slot a menu.
MENU_LINKS, MENU_BLOCKS = 80, 2
#: Copies of each host's template that its pages are dealt to.
SALT = 16

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")

# Fixed values of HTML: elements without content, with content that isn't text, those of them that may hold their like or close at once, elements that start a block, and which open elements a start tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object"}
NESTED, FOREIGN = {"template", "svg", "math", "object"}, {"svg", "math"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Names of elements, roles, and words of class and id that mark boilerplate or content, and words that mark neither.
NOT_MAIN = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "label", "fieldset"}
NOT_MAIN_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
NOT_MAIN_WORD = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs ccpa comment comments cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
MAIN, MAIN_ROLE, MAIN_WORD = {"article", "main"}, {"main", "article"}, {"article", "content", "entry", "post", "story"}
GENERAL_WORD = set("area bar block body bottom box buttons column container form global inner item left links list main outer page panel right section site slot teaser text top unit wrap wrapper".split())
# Of the words that mark boilerplate, those that do so whatever content they stand with, and words for that content: related-posts, user-comments.
BESIDE_MAIN_WORD = set("comment comments cookie cookies newsletter recommended related replies share sharing social subscribe".split())
CONTENT_WORD = set("article articles content entries entry guest links media more policy post posts read reader readers reading stories story user users visitor".split())


def _key(text: str) -> int:
    """A token's key: even for elements; blocks add one."""
    return (xxhash.xxh64_intdigest(text) - (1 << 63)) & ~1


def _marked(marks: str, by: set[str]) -> bool:
    """Whether one of the marks has words of a set and none but general ones besides; of boilerplate, some words mark it beside words for content too."""

    def all_of(words: set[str]) -> bool:
        rest = words - by - GENERAL_WORD
        return not rest or by is NOT_MAIN_WORD and bool(words & BESIDE_MAIN_WORD) and not rest - CONTENT_WORD

    return any(words & by and all_of(words) for words in ({*_WORD.findall(x)} for x in marks.split()))


class Page:
    """Of a page: tokens (keys in order), and of its blocks: their places among the tokens, texts, levels (2 within an article, 1 within marked content) and characters in links."""

    def __init__(self, text: str):
        self.tokens: list[int] = []
        self.places: list[int] = []
        self.texts: list[str] = []
        self.levels: list[int] = []
        self.links: list[int] = []
        self._stack: list[tuple[str, int, bool, int, bool]] = []  # tag, path's key, boilerplate, level, link
        self._parts: list[tuple[str, bool]] = []
        at, n = 0, len(text)
        while at < n:
            m = _TAG.search(text, at)
            if m is None:
                self._text(text[at:])
                break
            if m.start() > at:
                self._text(text[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if tag in RAW:
                    at = at if m[1] or tag in FOREIGN and m[3].endswith("/") else self._behind(tag, text, at)
                elif m[1]:
                    self._close(tag)
                else:
                    self._open(tag, m[3])
        self._flush()

    @staticmethod
    def _behind(tag: str, text: str, at: int) -> int:
        """Where the text goes on behind an element whose content isn't text."""
        depth = 1
        for m in re.compile(f"<(/?){tag}\\b[^>]*(?:>|\\Z)", re.I).finditer(text, at):
            depth += -1 if m[1] else 1 if tag in NESTED and not m[0].endswith("/>") else 0
            if not depth:
                return m.end()
        return len(text)

    def _text(self, text: str) -> None:
        if not self._stack or not self._stack[-1][2]:
            self._parts.append((text, bool(self._stack) and self._stack[-1][4]))

    def _flush(self) -> None:
        """Ends a block. Its place is that of the nearest element that starts one."""
        parts, self._parts = self._parts, []
        words = _BLANK.sub(" ", entities.unescape("".join(x for x, _ in parts))).strip() if parts else ""
        if words:
            path, level = 0, max((x[3] for x in self._stack), default=0)
            for tag, key, *_ in reversed(self._stack):
                if tag in BLOCK:
                    path = key
                    break
            self.places.append(len(self.tokens))
            self.tokens.append(_key(f"{path}#{words}") | 1)
            self.texts.append(words)
            self.levels.append(level)
            self.links.append(min(len(words), sum(len(x.strip()) for x, link in parts if link)))

    def _pop_to(self, i: int) -> None:
        if any(x[0] in BLOCK for x in self._stack[i:]):
            self._flush()
        del self._stack[i:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag in VOID and tag != "hr":
            return
        if tag in BLOCK:
            self._flush()
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i][0] == "p":
                    self._pop_to(i)
                    break
                if self._stack[i][0] in BLOCK:
                    break
            closes, within = CLOSES.get(tag, ((), ()))
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i][0] in within:
                    break
                if self._stack[i][0] in closes:
                    self._pop_to(i)
                    break
        if tag == "hr":
            return
        marks, role = "", ""
        if "=" in attributes:
            found = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)}
            marks, role = f"{found.get('class', '')} {found.get('id', '')}".strip().lower(), found.get("role", "").lower()
        _, path, boilerplate, level, link = self._stack[-1] if self._stack else ("", 0, False, 0, False)
        boilerplate = boilerplate or tag in NOT_MAIN or role in NOT_MAIN_ROLE or bool(marks) and tag not in ("html", "body", "article", "main") and _marked(marks, NOT_MAIN_WORD)
        if tag in MAIN or role in MAIN_ROLE:
            level = 2
        elif marks and tag not in ("html", "body") and _marked(marks, MAIN_WORD):
            level = max(level, 1)
        words = ".".join(sorted({*_WORD.findall(marks)})) if marks and tag not in ("html", "body") else ""
        path = _key(f"{path}/{tag}.{words}")
        self._stack.append((tag, path, boilerplate, level, link or tag == "a"))
        if tag in BLOCK:
            self.tokens.append(path)

    def _close(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                self._pop_to(i)
                return
            if self._stack[i][0] in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "thead", "tfoot"):
                return


PARSED = "page_id long, url string, host string, digest long, tokens binary, blocks binary, texts array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """Of rows (page_id, url, host, html): the same with, in the html's place, a digest, tokens (64-bit keys) and of the blocks: places, levels, characters in links and characters (32-bit numbers), and texts."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("digest", pa.int64()), ("tokens", pa.binary()), ("blocks", pa.binary()), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for page_id, url, host, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    page = Page(text)
                    numbers = np.array([page.places, page.levels, page.links, [len(x) for x in page.texts]], "<i4").tobytes()
                    out.append((page_id, url, host, xxhash.xxh64_intdigest(text) - (1 << 63), np.array(page.tokens, "<i8").tobytes(), numbers, page.texts))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, PARSED)


def _classes(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Of rows (host, digest, tokens): the large and frequent classes: host, class (fingerprint of the vector), pages, tokens."""
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("n_pages", pa.int64()), ("vector", pa.int64())])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sums: dict[tuple[str, int], list[int]] = {}
                for host, digest, raw in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    tokens = Counter(np.frombuffer(raw, "<i8").tolist())
                    tokens[0] = 1  # the page itself
                    each = {n: xxhash.xxh64_intdigest(f"{n} {digest}") for n in {*tokens.values()}}
                    for token, n in tokens.items():
                        row = sums.setdefault((host, token), [0, 0])
                        row[0] += 1
                        row[1] ^= each[n]
                out = [(h, t, n, v - (1 << 64) if v >> 63 else v) for (h, t), (n, v) in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    seen = distinct.select("host", "digest", "tokens").where(F.octet_length("tokens") > 0).mapInArrow(occurrences, "host string, token long, n_pages long, vector long")
    tokens = seen.groupBy("host", "token").agg(F.sum("n_pages").alias("pages"), F.expr("bit_xor(vector)").alias("class"))
    tokens = scratch.save(tokens.where(f"pages >= {LEAST_PAGES}"), "tokens")
    hosts = tokens.where("token = 0").select(F.col("host").alias("its_host"), F.col("pages").alias("host_pages"))
    element = F.col("token") % 2 == 0
    formed = tokens.where("token != 0").groupBy("host", "class", "pages").agg(F.count_if(element).alias("elements"), F.collect_list("token").alias("tokens"))
    enough = (100 * F.col("pages") >= SUPPORT * F.col("host_pages")) & ((100 * F.col("pages") >= MOST_PAGES * F.col("host_pages")) | (F.col("elements") >= LEAST_ELEMENTS))
    return formed.join(hosts, F.col("host") == F.col("its_host")).where(enough).select("host", "class", "pages", "tokens")


def _by_host(classes: DataFrame) -> DataFrame:
    """its_host, classes, a row for each salt."""
    one = classes.groupBy("host").agg(F.collect_list(F.struct(*(c for c in classes.columns if c != "host"))).alias("classes"))
    return one.select(F.col("host").alias("its_host"), "classes", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))


def _with_classes(rows: DataFrame, classes: DataFrame, *key: str) -> DataFrame:
    salt = F.pmod(F.xxhash64(*key), F.lit(SALT)).cast("int")
    found = _by_host(classes)
    return rows.join(found, (rows["host"] == found["its_host"]) & (salt == found["salt"]), "left").drop("its_host", "salt")


def class_of_tokens(classes: list[dict] | None) -> dict[int, int]:
    """Each token's class, as its number in the list."""
    return {token: k for k, c in enumerate(classes or []) for token in c["tokens"]}


def order_and_nesting(tokens: list[int], of: dict[int, int], sizes: list[int]) -> dict[int, int | None]:
    """Of each class on a page: a hash of the order of its tokens; None if they don't come in one order over and over, or the class doesn't nest."""
    seen: dict[int, list[int]] = {}
    bad: set[int] = set()
    stack: list[list[int]] = []  # class, its tokens so far
    for token in tokens:
        if (k := of.get(token)) is None:
            continue
        seen.setdefault(k, []).append(token)
        while stack and stack[-1][1] == sizes[stack[-1][0]]:
            stack.pop()
        if any(k == x[0] for x in stack):
            while stack[-1][0] != k:
                bad.add(stack.pop()[0])
            stack[-1][1] += 1
        else:
            stack.append([k, 1])
    bad.update(k for k, n in stack if n < sizes[k])
    out = {}
    for k, own in seen.items():
        size = sizes[k]
        regular = k not in bad and len(own) % size == 0 and own == own[:size] * (len(own) // size)
        out[k] = xxhash.xxh64_intdigest(np.array(own[:size], "<i8").tobytes()) - (1 << 63) if regular else None
    return out


def templates(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Of rows (host, digest, tokens), each content once: the valid classes: host, class, pages, tokens (in any order)."""
    classes = scratch.save(_classes(distinct, scratch), "classes")
    schema = pa.schema([("host", pa.string()), ("class", pa.int64()), ("order", pa.int64()), ("n", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sums: Counter = Counter()
                known: dict[str, tuple[dict[int, int], list[int], list[int]]] = {}
                rows = batch.slice(at, 512)
                for i, (host, raw) in enumerate(zip(*(rows.column(k).to_pylist() for k in (0, 1)))):
                    if host not in known:
                        found = rows.column(2)[i].as_py() or []
                        known[host] = class_of_tokens(found), [len(c["tokens"]) for c in found], [c["class"] for c in found]
                    of, sizes, names = known[host]
                    for k, order in order_and_nesting(np.frombuffer(raw, "<i8").tolist(), of, sizes).items():
                        sums[host, names[k], order] += 1
                out = [(*key, n) for key, n in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    checked = _with_classes(distinct.select("host", "digest", "tokens"), classes, "digest").select("host", "tokens", "classes")
    orders = checked.mapInArrow(check, "host string, class long, order long, n long").groupBy("host", "class", "order").agg(F.sum("n").alias("n"))
    best = orders.groupBy("host", "class").agg(F.sum("n").alias("all"), F.max(F.when(F.col("order").isNotNull(), F.col("n"))).alias("most"))
    valid = best.where(100 * F.col("most") >= MOST_PAGES * F.col("all")).select("host", "class")
    return scratch.save(classes.join(valid, ["host", "class"], "left_semi"), "valid")


def elements_of(classes: list[dict]) -> tuple[dict[int, int], list[int]]:
    """Each element's class, as its number in the list, and the number of elements of each class."""
    of = {token: k for token, k in class_of_tokens(classes).items() if token % 2 == 0}
    return of, [sum(t % 2 == 0 for t in c["tokens"]) for c in classes]


def slots(tokens: list[int], of: dict[int, int], sizes: list[int]) -> list[tuple[int, int] | None]:
    """Of each token of a page: the slot that it is in, as (class, element before it), (-1, 0) outside of all classes; None for elements of the template. of and sizes are those of elements."""
    out: list[tuple[int, int] | None] = []
    stack: list[list[int]] = []  # class, its elements so far, the last of them
    for token in tokens:
        if (k := of.get(token)) is None:
            out.append((stack[-1][0], stack[-1][2]) if stack else (-1, 0))
            continue
        out.append(None)
        at = next((i for i, x in enumerate(stack) if x[0] == k), None)
        if at is None or stack[at][1] == sizes[k]:
            # A class that is complete goes on until another one's element: behind its last element is a slot too.
            while stack and (stack[-1][1] == sizes[stack[-1][0]] or stack[-1][0] == k):
                stack.pop()
            stack.append([k, 1, token])
        else:
            del stack[at + 1 :]
            stack[at][1:] = [stack[at][1] + 1, token]
    return out


def with_menus(distinct: DataFrame, valid: DataFrame) -> DataFrame:
    """Of rows (host, digest, tokens, blocks), each content once: the valid classes with menus: those of their elements behind which a menu stands, by all pages of the host."""
    schema = pa.schema([("host", pa.string()), ("class", pa.int64()), ("token", pa.int64()), *((c, pa.int64()) for c in ("n_pages", "n_blocks", "n_chars", "n_links"))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sums: dict[tuple[str, int, int], list[int]] = {}
                known: dict[str, tuple[dict[int, int], list[int], list[int]]] = {}
                rows = batch.slice(at, 512)
                for i, (host, raw, numbers) in enumerate(zip(*(rows.column(k).to_pylist() for k in range(3)))):
                    if host not in known:
                        found = rows.column(3)[i].as_py() or []
                        known[host] = *elements_of(found), [c["class"] for c in found]
                    of, sizes, names = known[host]
                    slot = slots(np.frombuffer(raw, "<i8").tolist(), of, sizes)
                    places, _, links, chars = np.frombuffer(numbers, "<i4").reshape(4, -1).tolist()
                    seen = set()
                    for place, link, n in zip(places, links, chars):
                        k, token = slot[place]
                        if k >= 0:
                            row = sums.setdefault((host, names[k], token), [0, 0, 0, 0])
                            for j, x in enumerate(((k, token) not in seen, 1, n, link)):
                                row[j] += x
                            seen.add((k, token))
                out = [(*key, *row) for key, row in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = _with_classes(distinct.select("host", "digest", "tokens", "blocks"), valid, "digest").where("classes IS NOT NULL").select("host", "tokens", "blocks", "classes")
    counted = rows.mapInArrow(look, "host string, class long, token long, n_pages long, n_blocks long, n_chars long, n_links long")
    counted = counted.groupBy("host", "class", "token").agg(*(F.sum(c).alias(c) for c in ("n_pages", "n_blocks", "n_chars", "n_links")))
    menus = counted.where(f"100 * n_links >= {MENU_LINKS} * n_chars AND n_blocks >= {MENU_BLOCKS} * n_pages AND n_pages >= {LEAST_PAGES}")
    return valid.join(menus.groupBy("host", "class").agg(F.collect_list("token").alias("menus")), ["host", "class"], "left")


def main_text(levels: list[int], links: list[int], texts: list[str], slot: list[tuple[int, int]], own_words: list[bool], menus: set[tuple[int, int]], keep_article: bool) -> list[int]:
    """Which of a page's blocks are its main text, by their slots and by whether they are words of the template's own."""
    top = max(levels, default=0)
    chosen = [i for i in range(len(texts)) if levels[i] >= top and slot[i] not in menus and (top == 2 and keep_article or not own_words[i])]
    if top == 2:
        return chosen
    full, linked = Counter(), Counter()
    for i in chosen:
        full[slot[i]] += len(texts[i])
        linked[slot[i]] += links[i]
    return [i for i in chosen if 2 * linked[slot[i]] <= full[slot[i]]]


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", keep_article: bool = False) -> DataFrame:
    """One row per page: page_id, url, text, template_pages (the distinct pages of its template's largest class; 0 without one), slots (of each block of the text: name and characters). With keep_article, the template's words are dropped outside of articles alone."""
    scratch = Scratch(prepare(pages.sparkSession))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_column), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"), host.alias("host"))
    rows = scratch.save(parsed(rows), "parsed")
    distinct = rows.groupBy("host", "digest").agg(F.first(F.struct("tokens", "blocks")).alias("_")).select("host", "digest", "_.tokens", "_.blocks")
    distinct = scratch.save(distinct, "distinct")
    valid = scratch.save(with_menus(distinct, templates(distinct, scratch)), "menus")
    scratch.drop("tokens", "classes", "distinct", "valid")
    joined = _with_classes(rows, valid, "page_id", "digest").select("page_id", "url", "host", "tokens", "blocks", "texts", "classes")
    spot = pa.list_(pa.struct([("slot", pa.string()), ("n_chars", pa.int64())]))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("template_pages", pa.int64()), ("slots", spot)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                known: dict[str, tuple] = {}
                some = batch.slice(at, 256)
                for i, (page_id, url, host, raw, numbers, texts) in enumerate(zip(*(some.column(k).to_pylist() for k in range(6)))):
                    if host not in known:
                        found = some.column(6)[i].as_py() or []
                        menus = {(k, token) for k, c in enumerate(found) for token in c["menus"] or []}
                        known[host] = class_of_tokens(found), *elements_of(found), menus, found
                    of, elements, sizes, menus, found = known[host]
                    tokens = np.frombuffer(raw, "<i8").tolist()
                    places, levels, links, _ = np.frombuffer(numbers, "<i4").reshape(4, -1).tolist()
                    all_slots = slots(tokens, elements, sizes)
                    slot = [all_slots[place] for place in places]
                    chosen = main_text(levels, links, texts, slot, [tokens[place] in of for place in places], menus, keep_article)
                    name = lambda s: "" if s[0] < 0 else f"{found[s[0]]['class'] & (1 << 64) - 1:016x}.{s[1] & (1 << 64) - 1:016x}"  # noqa: B023, E731
                    n = max((found[k]["pages"] for k in {of[t] for t in tokens if t in of}), default=0)
                    spots = [{"slot": name(slot[i]), "n_chars": len(texts[i])} for i in chosen]
                    out.append((page_id, url, "\n".join(texts[i] for i in chosen), n, spots))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return joined.mapInArrow(cut, "page_id long, url string, text string, template_pages long, slots array<struct<slot:string,n_chars:long>>")
