"""Main text of web pages by union-free regular expressions, inferred for each host.

A page is read as a stream of block tags and texts; inline tags count as part of the text. Equal neighbours, and equal
runs of up to MAX_PERIOD blocks, fold into repeated groups. A host's wrapper starts as its first page; every other page
is aligned with it, level by level: what only one side has becomes optional, what one side repeats becomes a repeated
group, and texts that differ become slots. Alignment is associative up to the order of pages, so tasks align their own
pages first, and the wrappers of a host are aligned in two shuffles, of which the first splits hosts by a salt.

A wrapper's blocks are then labelled: menus, headers, footers, sidebars, notices, adverts, forms and reader comments are
told by tag, class, id and role; of what is left the article is kept, or, on hosts without such an element, the
innermost block that holds most of the text that isn't links. The slots overrule class words: a block that is told by
class, id or role alone, but has SLOT_SHARE times the slot text of all that is left, is where the pages differ, and its
name is kept. A page is matched with the wrapper of its host, and the texts in kept blocks are its main text, but for the
wrapper's fixed texts: a text that stayed the same through all alignments, and is at its place on LEAST_PAGES different pages
and over half of the host's, belongs to the template, inside an article too, whatever its block is called; texts of slots
stay, and a line that many articles share in a group of paragraphs is in a slot. On hosts whose pages have no article or main element, a place in
the tree whose text is the same on over half of the host's different pages holds fixed text as well, whatever its
neighbours fold into. A page in which nothing matches, and a page of a host that has only one, is matched with a wrapper of
its own, which has no fixed texts.

Blocks nested deeper than MAX_DEPTH are read at that depth, as browsers do; no text is lost by it. Null and empty pages
have an empty text. A null url is a host of its own. Repeated rows are returned each, and count once where fixed text is
told. Only page_id, url and html are read; other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import durable, hot_keys, slices, small_batches, split_join

MAX_PERIOD = 4
#: Blocks inside one another; deeper ones stand at this depth.
MAX_DEPTH = 160
#: Steps of an exact alignment of two levels; larger ones are aligned with the next equal block.
MAX_STEPS = 1_000_000
#: Wrappers up to this size in all are sent to all tasks; beyond it pages are joined with them by host.
MAX_BROADCAST_BYTES = 8_000_000
#: Pages that a fixed text is on at least; how much more slot text than all else has overrules class words.
LEAST_PAGES, SLOT_SHARE = 4, 3
#: Parts into which a host's wrappers are split before the last alignment.
SALT = 32

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math select object".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
FENCES = {"ul", "ol", "dl", "table", "article", "body", "html"}
DROP_TAGS = set("nav footer aside form head button input dialog menu".split()) | RAW
DROP_WORDS = re.compile(
    r"(?:^|[-_ .])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|sidebar|side|footer|header|masthead|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe"
    r"|social|share|sharing|related|recommend\w*|comments?|commentlist|disqus|replies|breadcrumbs?|pagination|pager|widget|login|signup|search|complementary|contentinfo)(?=$|[-_ .])"
)
MAIN_WORDS = re.compile(r"(?:^|[-_ .])(?:article|content|post|entry|story|main|text|body)(?=$|[-_ .])")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*)>|<[/!?][^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

# A text is ["#", fixed text's hash or None, optional, characters, of these in links, place of the page's text];
# a block is [key, items, optional, repeated]; a repeated run of several blocks has the key "()".


def key_of(tag: str, attributes: str) -> str:
    """The tag with what class, id and role say; "!" marks what is hidden."""
    if "=" not in attributes and "hidden" not in attributes:
        return tag
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    names = " ".join(found[k] for k in ("id", "class", "role") if k in found).lower()
    hidden = HIDDEN.search(found.get("style", "").lower()) or re.search(r"(?:^|\s)hidden(?:$|[\s=])", attributes) or found.get("aria-hidden") == "true"
    return tag + ("." + re.sub(r"[\s\d]+", " ", names).strip() if names else "") + ("!" if hidden else "")


def parse(page: str) -> tuple[list, list[str]]:
    """(items, texts): the block tree of a page, and its texts."""
    root: list = ["", [], False, False]
    stack, texts = [("", root)], []
    part: list[str] = []
    links = depth = 0

    def flush() -> None:
        nonlocal links
        if part:
            text = " ".join(html.unescape("".join(part)).split())
            part.clear()
            if text:
                stack[-1][1][1].append(["#", hash_of(text), False, len(text), min(links, len(text)), len(texts)])
                texts.append(text)
            links = 0

    def close(names: set[str], fences: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in fences:
                return

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            part.append(piece)
            if depth:
                links += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                part.append("\n")
            elif tag == "a":
                depth = 0 if m[1] else 1
            continue
        flush()
        depth = 0
        if m[1]:
            close({tag}, {"body", "html"} - {tag} if tag != "p" else FENCES)
            continue
        if tag in CLOSES_P:
            close({"p"}, FENCES | {"div", "section", "td", "form", "main", "aside", "nav", "header", "footer"})
        if tag in SIBLINGS:
            close(SIBLINGS[tag], FENCES)
        if tag in RAW and tag not in VOID:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        node: list = [key_of(tag, m[3] or ""), [], False, False]
        stack[-2 if len(stack) > MAX_DEPTH and tag not in VOID else -1][1][1].append(node)
        if tag not in VOID and not (m[3] or "").endswith("/"):
            if len(stack) > MAX_DEPTH:
                above = stack.pop()  # its end tag will find nothing to close
                if unwanted(above[1][0]) and not node[0].endswith("!"):
                    node[0] += "!"
            stack.append((tag, node))
    flush()
    return root[1], texts


def hash_of(text: str) -> int:
    """63 bits that name a text."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def copied(items: list) -> list:
    """Items without places in a page."""
    return [x[:5] if x[0] == "#" else [x[0], copied(x[1]), x[2], x[3]] for x in items]


def joined(x: list, y: list) -> list:
    """One item for two of the same key."""
    if x[0] == "#":
        return ["#", x[1] if x[1] == y[1] else None, x[2] or y[2], x[3] + y[3], x[4] + y[4]]
    return [x[0], aligned(x[1], y[1]), x[2] or y[2], x[3] or y[3]]


def shape(items: list) -> tuple:
    return tuple(x[0] for x in items)


def folded(items: list) -> list:
    """Items with neighbours of one key, and repeated runs, folded into repeated groups, from the inside out."""
    out: list = []
    for x in items:
        x = x if x[0] == "#" else [x[0], folded(x[1]), x[2], x[3]]
        if out and out[-1][0] == x[0]:
            out[-1] = joined(out[-1], x)
            if x[0] != "#":
                out[-1][3] = True
        else:
            out.append(x)
    for p in range(2, MAX_PERIOD + 1):
        keys, i, runs = shape(out), 0, []
        while i < len(out):
            j = i + p
            while keys[i:j] and keys[j : j + p] == keys[i : i + p]:
                j += p
            if j > i + p:
                body = out[i : i + p]
                for k in range(i + p, j, p):
                    body = aligned(body, out[k : k + p])
                runs.append(["()", body, False, True])
                i = j
            else:
                runs.append(out[i])
                i += 1
        out = runs
    return out


def aligned(one: list, two: list) -> list:
    """The items that match both: a longest common subsequence of keys is joined, the rest becomes optional."""
    if shape(one) == shape(two):
        return [joined(x, y) for x, y in zip(one, two, strict=True)]
    n, m = len(one), len(two)
    if n * m > MAX_STEPS:
        pairs = next_equal(shape(one), shape(two))
    else:
        pairs = common(shape(one), shape(two))
    out, i, j = [], 0, 0
    for x, y in [*pairs, (n, m)]:
        for z in one[i:x] + two[j:y]:
            z = list(z)
            z[2] = True
            out.append(z)
        if x < n:
            out.append(joined(one[x], two[y]))
        i, j = x + 1, y + 1
    return folded(out) if any(x[0] == y[0] for x, y in zip(out, out[1:], strict=False)) else out


def common(one: tuple, two: tuple) -> list[tuple[int, int]]:
    """The places of a longest common subsequence."""
    n, m = len(one), len(two)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if one[i] == two[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if one[i] == two[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def next_equal(one: tuple, two: tuple) -> list[tuple[int, int]]:
    """The places of a common subsequence: each of one with the next equal of two that isn't far ahead."""
    places: dict[str, list[int]] = {}
    for j, k in enumerate(two):
        places.setdefault(k, []).append(j)
    out, j, near = [], 0, max(16, len(two) // max(1, len(one)) * 16)
    for i, k in enumerate(one):
        at = places.get(k, [])
        p = bisect_left(at, j)
        if p < len(at) and at[p] - j <= near:
            out.append((i, at[p]))
            j = at[p] + 1
    return out


def mass(items: list) -> int:
    """Characters of text outside links, without what is always dropped."""
    return sum(x[3] - x[4] if x[0] == "#" else 0 if unwanted(x[0]) else mass(x[1]) for x in items)


def slot_mass(items: list, dropped: bool = False) -> int:
    """Characters of slots' text outside links: without what is always dropped, or with what only its names drop."""
    return sum((x[3] - x[4] if x[1] is None else 0) if x[0] == "#" else 0 if unwanted(x[0]) and not (dropped and named_only(x[0])) else slot_mass(x[1], dropped) for x in items)


def named_only(key: str) -> bool:
    """Whether class, id or role alone drop a block."""
    return unwanted(key) and not unwanted(key.partition(".")[0]) and not key.endswith("!")


def overruled(items: list) -> set[str]:
    """The keys of blocks that their names drop although SLOT_SHARE times more of the slots' text is in them than in all that is left."""
    left, out = slot_mass(items), set()

    def look(some: list) -> None:
        for x in some:
            if x[0] == "#":
                continue
            if named_only(x[0]):
                if slot_mass(x[1], True) > SLOT_SHARE * max(left, 1):
                    out.add(x[0])
                    look(x[1])
            elif not unwanted(x[0]):
                look(x[1])

    look(items)
    return out


def renamed(items: list, names: set[str]) -> list:
    """Items whose blocks of these keys have their tag only, so that nothing drops them."""
    return [x if x[0] == "#" else [x[0].partition(".")[0] if x[0] in names else x[0], renamed(x[1], names), *x[2:]] for x in items]


def unwanted(key: str, inside: bool = False) -> bool:
    tag, _, names = key.partition(".")
    if key.endswith("!") or tag in DROP_TAGS or (tag == "header" and not inside):
        return True
    return bool(names) and tag not in ("body", "html", "article", "main") and DROP_WORDS.search(names) is not None


def roots(items: list, wanted) -> list:
    """The outermost blocks that `wanted` accepts, outside of what is dropped."""
    out = []
    for x in items:
        if x[0] != "#" and not unwanted(x[0]):
            out += [x] if wanted(x[0]) else roots(x[1], wanted)
    return out


def main_blocks(items: list) -> tuple[list[int], bool]:
    """(the ids of the wrapper's blocks whose texts are the main text; whether an article or main element says so)."""
    for tag in ("article", "main"):
        found = [x for x in roots(items, lambda k, t=tag: k.partition(".")[0] == t or (t == "main" and "main" in k.partition(".")[2].split())) if mass(x[1])]
        if found:
            return [id(x) for x in found], True
    named = roots(items, lambda k: MAIN_WORDS.search(k.partition(".")[2]) is not None and k.partition(".")[0] not in ("body", "html"))
    named.sort(key=lambda x: -mass(x[1]))
    if named and 2 * mass(named[0][1]) > mass(items):
        return [id(named[0])], False
    block: list = ["", items]
    while True:
        inner = [x for x in block[1] if x[0] != "#" and not unwanted(x[0]) and x[0].partition(".")[0] in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center", "()")]
        best = max(inner, key=lambda x: mass(x[1]), default=None)
        if best is None or 2 * mass(best[1]) <= mass(block[1]) or best[0] == "()":
            return [id(block) if block[0] else 0], False
        block = best


def places_of(items: list, above: int = 0) -> Iterator[tuple[int, int]]:
    """(name of a text together with the blocks that it is in, its place) of a page's texts."""
    for x in items:
        if x[0] == "#":
            yield hash_of(f"{above}#{x[1]}"), x[5]
        else:
            yield from places_of(x[1], hash_of(f"{above}/{x[0]}"))


class Extractor:
    """A labelled wrapper of so many different pages; template and, on hosts without articles, fixed hold the names of texts that
    the host's pages share, template those that are fixed in the wrapper as well."""

    def __init__(self, items: list, fixed: set[int], template: set[int] = frozenset(), pages: int = 1):
        self.names = overruled(items) if pages >= LEAST_PAGES else set()
        self.items = renamed(items, self.names) if self.names else items
        blocks, sure = main_blocks(self.items)
        self.main, self.fixed = set(blocks), set() if sure else fixed
        self.template = template

    def places(self, page: list) -> list[int]:
        """The places of the page's texts that fall into kept slots."""
        out: list[int] = []
        names = {at: name for name, at in places_of(page)} if self.fixed or self.template else {}
        page = renamed(page, self.names) if self.names else page
        self._match(page, self.items, 0 in self.main, out, {at for at, name in names.items() if name in self.template})
        return [at for at in out if names.get(at) not in self.fixed] if self.fixed else out

    def _match(self, page: list, items: list, keep: bool, out: list[int], shared: set[int]) -> None:
        flat = [y for x in items for y in (x[1] if x[0] == "()" else [x])]
        inside = {id(y): id(x) in self.main for x in items if x[0] == "()" for y in x[1]}
        where: dict[str, list[int]] = {}
        for k, y in enumerate(flat):
            where.setdefault(y[0], []).append(k)
        fixed = {y[1] for y in flat if y[0] == "#"}
        at = 0
        for x in page:
            if x[0] == "#":
                if keep and not (x[5] in shared and x[1] in fixed):
                    out.append(x[5])
                continue
            if unwanted(x[0], keep):
                continue
            found = where.get(x[0])
            if not found:
                self._match(x[1], [], keep, out, shared)  # no page of the host that was aligned has it here
                continue
            p = bisect_left(found, at)
            at = found[p] if p < len(found) else found[0]
            w = flat[at]
            self._match(x[1], w[1], keep or id(w) in self.main or inside.get(id(w), False), out, shared)


def main_text(page: str, wrapper: Extractor | None) -> str:
    items, texts = parse(page)
    places = wrapper.places(items) if wrapper else []
    if not places and texts:
        places = Extractor(folded(copied(items)), set()).places(items)
    return "\n\n".join(texts[i] for i in places)


def shared_texts(pages: DataFrame) -> DataFrame:
    """(host, pages, template, fixed): a host's different pages, and the names of texts, in their blocks, that over half of them have.

    template: of all pages, LEAST_PAGES at least; fixed: of the pages without an article or main tag, two at least. A text that
    so many pages have is at most twice as common as an average page is long, so a row is as small as two pages."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            hosts, found = [], []
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if page:
                    mine = {name for name, _ in places_of(parse(page)[0])}
                    body, plain = hash_of(",".join(map(str, sorted(mine)))), not ARTICLE.search(page)
                    hosts += [host] * (len(mine) + 1)
                    found += [(body, plain, None), *((body, plain, name) for name in mine)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.int64()))]], ["host", "body", "plain", "name"])

    rows = durable(pages.select("host", "html").mapInArrow(named, "host string, body long, plain boolean, name long").distinct())
    count = [F.count("*").alias("c"), F.count(F.when(F.col("plain"), 1)).alias("plain")]
    many = rows.where("name is null").groupBy("host").agg(F.count("*").alias("pages"), F.count(F.when(F.col("plain"), 1)).alias("plain_pages"))
    often = rows.where("name is not null").groupBy("host", "name").agg(*count).where("c > 1").join(many, "host")
    template = F.collect_list(F.when((F.col("c") >= LEAST_PAGES) & (2 * F.col("c") > F.col("pages")), F.col("name")))
    fixed = F.collect_list(F.when((F.col("plain") > 1) & (2 * F.col("plain") > F.col("plain_pages")), F.col("name")))
    return many.select("host", "pages").join(often.groupBy("host").agg(template.alias("template"), fixed.alias("fixed")), "host", "left")


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of every host."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(x) for x in found.values()], pa.string())], ["host", "wrapper"])

        for b in slices(batches, "html"):
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if page:
                    items = folded(copied(parse(page)[0]))
                    found[host] = aligned(found[host], items) if host in found else items
            if len(found) > 20_000:
                yield from out()
                found = {}
        yield from out()

    def merged(t: pa.Table) -> pa.Table:
        wrapper = None
        for x in sorted(t.column("wrapper").to_pylist()):
            x = json.loads(x)
            wrapper = x if wrapper is None else aligned(wrapper, x)
        out = {"host": t.column("host")[:1], "salt": pa.array([t.column("salt")[0].as_py()], pa.int32()), "wrapper": pa.array([json.dumps(wrapper)], pa.string())}
        return pa.table(out)

    kind = "host string, salt int, wrapper string"
    first = pages.select("host", "html").mapInArrow(own, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALT)).cast("int"))
    some = first.groupBy("host", "salt").applyInArrow(merged, kind).withColumn("salt", F.lit(0))
    return some.groupBy("host").applyInArrow(merged, kind).select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    url = F.col("url").cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select("page_id", url.alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    kind = dict(rows.dtypes)["page_id"]
    wrappers = durable(infer(rows).join(shared_texts(rows), "host", "left"))
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + 8 * (F.coalesce(F.size("fixed"), F.lit(0)) + F.coalesce(F.size("template"), F.lit(0)))), F.lit(0))).first()[0]
    known: dict[str, tuple] | None = None
    if size <= MAX_BROADCAST_BYTES:
        known = {r.host: (r.wrapper, r.fixed, r.template, r.pages) for r in wrappers.collect()}
    else:
        counts = rows.groupBy("host").count()
        rows = split_join(rows, wrappers, "host", hot_keys(counts, "host", rows.count()), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Extractor] = {}
        for b in slices(batches, "html"):
            texts = []
            hosts = b.column("host").to_pylist()
            found = [known.get(h, (None, None, None, 0)) for h in hosts] if known is not None else zip(*[b.column(c).to_pylist() for c in ("wrapper", "fixed", "template", "pages")], strict=True)
            for name, page, (wrapper, fixed, template, many) in zip(hosts, b.column("html").to_pylist(), found, strict=True):
                if wrapper and name not in ready:
                    if len(ready) > 1000:
                        ready.clear()
                    ready[name] = Extractor(json.loads(wrapper), set(fixed or []), set(template or []), many or 1)
                texts.append(main_text(page, ready.get(name)) if page else "")
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
