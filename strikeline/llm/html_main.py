"""Main text of web pages by equivalence classes of template tokens.

1. Every page becomes a list of blocks (path of elements, text), and its tokens:
   the paths of its elements and the (path, text) of its blocks, with counts and
   first and last places.  One compact row per page is written to the shared folder.
2. Pages of a host whose kept blocks (step 4) are equal count once, whatever
   their scripts, comments and adverts.  For every (host, token) an
   aggregation with map-side partial sums yields the number of pages and a
   fingerprint of the occurrence vector (the sum over pages of a hash of page and
   count), so tokens with equal vectors are found without putting a host's pages
   together anywhere, however many it has.
3. Tokens of a host with equal fingerprints are an equivalence class; a class is
   valid if it covers at least ``SUPPORT`` of the host's pages (and ``LEAST``
   pages).  Valid classes nest: a class lies in the gap between two markup tokens of
   the smallest class around it (by mean places).  Their texts may be the template's.
   They are if the class also covers ``SUPPORT`` of the host's different pages
   (and ``LEAST``) by what is left without such texts.  Pages with nothing left,
   and marked articles with less left than taken, are copies: all count as one.
   Markup tokens that cover as many pages bound slots, and what fills a slot over
   the whole host tells its kind: one that is mostly link text, names no role and
   holds less than the host's largest slot of other text is a menu, unless the
   smallest class around it repeats a slot of other text: links between the
   paragraphs of an article belong to it.
4. What is not template text fills slots.  Menus found so are dropped, unless a
   page would have no text without them.  Any other slot's role comes from its path:
   menus, headers, footers, sidebars, notices, adverts, forms and comments are
   dropped; the slots inside the article are kept, or, if a page marks no
   article, all slots that have no such role.

The template is broadcast below ``BROADCAST_TOKENS`` texts; beyond that it is joined
by host (AQE splits a hot host, whose template side is one row).

Defined results: null html is an empty page with empty text; pages without a
url share the empty host; a host with fewer than ``LEAST`` different pages has no
template texts; repeated rows are extracted each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeline.llm.common import materialise, pieces

SUPPORT = 0.6
LEAST = 5
BROADCAST_TOKENS = 20_000
BATCH_BYTES = 4 << 20

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[A-Za-z][^<>]*>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements and words of class names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea title select audio video canvas annotation annotation-xml".split())
#: Of these, the ones that run to the page's end if nothing closes them.
OPEN_RAW = frozenset("script style textarea title".split())
MATH = frozenset("math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mpadded mphantom menclose merror".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
DROP = frozenset("head nav aside footer form button menu dialog fieldset datalist".split())
ARTICLE = frozenset("article main".split())
ARTICLE_WORDS = ({"article", "body"}, {"post", "content"}, {"entry", "content"}, {"article", "content"}, {"main", "content"}, {"story", "body"}, {"post", "body"})
DROP_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs
    pagination pager footer sidebar sidebars aside widget widgets related recommended recommendations share sharing social cookie cookies consent
    gdpr notice notices alert banner popup modal overlay subscribe subscription newsletter signup login comment comments disqus respond replies
    masthead topbar toolbar skip""".split()
)
HEADER_WORDS = frozenset("header hdr".split())
#: Elements that an opening tag of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Element:
    __slots__ = ("article", "drop", "key", "name", "soft")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        own = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        label = f"{own.get('class', '')} {own.get('id', '')}".strip() if name not in ("html", "body") else ""
        words = {w.lower() for w in PART.findall(label)} if label else set()
        role = own.get("role", "").lower()
        self.name = name
        # names the path from the root; a rolling hash, so that depth costs nothing
        self.key = xxhash.xxh3_64_intdigest(f"{name}[{label}]", parent.key if parent else 0)
        above = parent
        inside = bool(above and above.article)
        hidden = "hidden" in own or "display:none" in own.get("style", "").replace(" ", "").lower()
        # always dropped, whatever lies inside
        self.drop = bool(above and above.drop) or name in DROP or hidden or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert") or (name == "header" and not inside) or (inside and bool(words & DROP_WORDS))
        # dropped unless the article lies inside
        self.soft = (bool(above and above.soft) or bool(words & DROP_WORDS) or (not inside and bool(words & HEADER_WORDS))) and not self.drop
        itself = name in ARTICLE or role in ("main", "article") or own.get("itemprop", "") == "articleBody" or any(w <= words for w in ARTICLE_WORDS)
        self.article = inside or (itself and not self.drop and not (words & DROP_WORDS))
        if self.article and not inside:
            self.soft = False


def parse(page: str) -> list[tuple[Element, str]]:
    """The blocks of a page in order: the element that holds each and its text."""
    return [(e, t) for e, t, _ in parse_linked(page)]


def parse_linked(page: str) -> list[tuple[Element, str, int]]:
    """The same with the characters of each text that lie in links (without white space)."""
    stack: list[Element] = [Element("", "", None)]
    out: list[tuple[Element, str, int]] = []
    text: list[str] = []
    linked = 0
    block = stack[0]
    at = 0
    unclosed: set[str] = set()
    held: dict[str, int] = {}  # how often each name is open

    def close(depth: int) -> None:
        for e in stack[depth:]:
            held[e.name] -= 1
        del stack[depth:]

    def flush(after: Element) -> None:
        nonlocal text, block, linked
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            if said:
                out.append((block, said, min(linked, len(said))))
            text, linked = [], 0
        block = after

    while True:
        m = MARKUP.search(page, at)
        if at < (stop := m.start() if m else len(page)):
            text.append(page[at:stop])
            if held.get("a"):
                linked += sum(map(len, entities.unescape(text[-1]).split()))
        if not m:
            flush(block)
            return out
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
                if end:
                    at = end.end()
                elif name in OPEN_RAW:
                    at = len(page)
                else:
                    unclosed.add(name)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush(stack[-1])
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0) if held.get(name) else 0
            if depth:
                ends = any(e.name not in INLINE for e in stack[depth:])
                if ends:
                    flush(block)
                close(depth)
                if ends:
                    block = stack[-1]
            continue
        if name not in INLINE:
            closes = CLOSES.get(name, {"p"})
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closes:
                    flush(block)
                    close(i)
                    break
                if stack[i].name not in INLINE and stack[i].name != "p":
                    break
        opened = Element(name, m[3], stack[-1])
        if name not in INLINE or opened.drop != stack[-1].drop or opened.soft != stack[-1].soft:
            flush(opened)
        if not m[3].endswith("/"):
            stack.append(opened)
            held[name] = held.get(name, 0) + 1


def token(path: int, text: str | None = None) -> int:
    """A signed 64-bit name of an element's path, or of a block's path and text."""
    return (path if text is None else xxhash.xxh3_64_intdigest(text, path)) - (1 << 63)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def kept_of(blocks: list[tuple[Element, str]]) -> tuple[list[tuple[Element, str]], bool]:
    """The blocks in article slots, by role, and whether the page marks an article."""
    marked = any(e.article for e, _ in blocks)
    return [(e, t) for e, t in blocks if not e.drop and not e.soft and (e.article or not marked)], marked


def extract(page: str | None, template: set[int]) -> str:
    """The main text: article slots without template texts and menus, both named by their tokens."""
    kept, _ = kept_of(parse(page) if page else [])
    said = [(e, t) for e, t in kept if token(e.key, t) not in template]
    slots = [(e, t) for e, t in said if token(e.key) not in template]
    return "\n\n".join(t for _, t in slots or said)


def page_tokens(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One written row per page: host, hashes of its kept and of all blocks, tokens with counts, first and last places, kept texts with lengths,
    and per path of blocks its characters, those in links, and whether it was kept without being part of an article."""

    def digest(texts: list[int], marked: bool) -> int:
        return xxhash.xxh3_64_intdigest(repr((texts, marked))) - (1 << 63)

    def run(batches):
        for batch in pieces(batches, "html", BATCH_BYTES):
            out: list[list] = [[] for _ in range(14)]
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count: dict[int, int] = {}
                place: dict[int, int] = {}
                end: dict[int, int] = {}
                texts: list[int] = []
                found = parse_linked(page.decode("utf-8", "replace")) if page else []
                blocks = [(e, t) for e, t, _ in found]
                slots: dict[int, list] = {}
                for element, text, linked in found:
                    if not element.drop and not element.soft:
                        own = slots.setdefault(token(element.key), [0, 0, True])
                        own[0] += sum(map(len, text.split()))
                        own[1] += linked
                        own[2] = own[2] and not element.article
                for i, (element, text) in enumerate(blocks):
                    for t in (token(element.key), token(element.key, text)):
                        count[t] = count.get(t, 0) + 1
                        place.setdefault(t, i)
                        end[t] = i
                    texts.append(token(element.key, text))
                texts_of = set(texts)
                kept, marked = kept_of(blocks)
                main = [token(e.key, t) for e, t in kept]
                of_slots = [[s[k] for s in slots.values()] for k in range(3)]
                row = (host_of(url), digest(main, marked), digest(texts, marked), list(count), [2 * n + (t in texts_of) for t, n in count.items()], [place[t] / len(blocks) for t in count], [end[t] / len(blocks) for t in count], main, [len(t) for _, t in kept], marked, list(slots), *of_slots)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["host", "page", "whole", "tokens", "counts", "places", "ends", "main", "chars", "marked", "slots", "own", "linked", "plain"])

    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    return materialise(rows.mapInArrow(run, "host string, page long, whole long, tokens array<long>, counts array<int>, places array<float>, ends array<float>, main array<long>, chars array<int>, marked boolean, slots array<long>, own array<long>, linked array<long>, plain array<boolean>"), "page-tokens")


def classes(tokens: DataFrame) -> DataFrame:
    """The valid equivalence classes of every host: fingerprint, tokens, pages, span of places, whether a page has it more than once, and the class around it."""
    distinct = tokens.groupBy("host", "page").agg(F.min_by(F.struct("tokens", "counts", "places", "ends"), "whole").alias("of")).select("host", "page", "of.*")
    size = distinct.groupBy("host").agg(F.count("*").alias("of"))
    flat = distinct.select("host", "page", F.explode(F.arrays_zip("tokens", "counts", "places", "ends")).alias("t")).select("host", "page", "t.*")
    vector = F.sum(F.xxhash64("page", F.shiftright("counts", 1)) % (1 << 40)).alias("vector")
    found = flat.groupBy("host", F.col("tokens").alias("token")).agg(vector, F.count("*").alias("pages"), F.max(F.col("counts") % 2 == 1).alias("is_text"), F.avg("places").alias("place"), F.avg("ends").alias("end"), F.sum(F.shiftright("counts", 1)).alias("n"))
    valid = found.where(F.col("pages") >= LEAST).join(size, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    grouped = valid.groupBy("host", "vector", "pages").agg(F.collect_set("token").alias("tokens"), F.collect_set(F.when(F.col("is_text"), F.col("token"))).alias("texts"), F.min("place").alias("first"), F.max("end").alias("last"), (F.max("n") > F.col("pages")).alias("repeats"))
    # the smallest class with markup around: of those that began before and end after the narrowest
    around = Window.partitionBy("host").orderBy("first", F.desc("last"), "vector").rowsBetween(Window.unboundedPreceding, -1)
    above = F.collect_list(F.when(F.size("tokens") > F.size("texts"), F.struct("last", "first", "vector"))).over(around)
    wide = F.filter(above, lambda c: c["last"] >= F.col("last"))
    return grouped.withColumn("parent", F.when(F.size(wide) > 0, F.element_at(F.array_sort(F.transform(wide, lambda c: F.struct((c["last"] - c["first"]).alias("width"), c["vector"].alias("vector")))), 1)["vector"]))


def template_texts(tokens: DataFrame, valid_classes: DataFrame) -> DataFrame:
    """The texts of valid classes that pages with different content of their own share: host, text."""
    found = valid_classes.select("host", "vector", F.explode("texts").alias("text"))
    said = tokens.select("host", "page", "marked", F.explode(F.arrays_zip("main", "chars")).alias("b")).select("host", "page", "marked", F.col("b.main").alias("text"), "b.chars")
    said = said.join(found, ["host", "text"], "left")
    alone = F.col("vector").isNull()
    chars = lambda which: F.sum(F.when(which, F.col("chars")).otherwise(0))
    key = F.sum(F.when(alone, F.xxhash64("text") % (1 << 40)))
    pages = said.groupBy("host", "page", "marked").agg(chars(alone).alias("own"), chars(~alone).alias("shared"), key.alias("key"), F.collect_set("vector").alias("vectors"))
    speaks = (F.col("own") > 0) & (~F.col("marked") | (F.col("own") >= F.col("shared")))
    pages = pages.select("host", F.when(speaks, F.col("key")).otherwise(F.lit(1 << 62)).alias("key"), "vectors")
    of = pages.groupBy("host").agg(F.countDistinct("key").alias("of"))
    spoken = pages.select("host", "key", F.explode("vectors").alias("vector")).groupBy("host", "vector").agg(F.countDistinct("key").alias("pages"))
    valid = spoken.where(F.col("pages") >= LEAST).join(of, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    return found.join(valid.select("host", "vector"), ["host", "vector"]).select("host", "text")


def menu_slots(tokens: DataFrame, valid_classes: DataFrame) -> DataFrame:
    """Slots without a role that hold mostly links, on hosts whose largest other slot holds more: host, text (the slot's token).

    A slot's support counts different pages, as that of classes does; its
    characters are sums with map-side partials, so a host's pages never meet.
    Where the class around a slot's own repeats a slot of other text, the slot
    lies between the pieces of that text and is no menu.
    """
    distinct = tokens.groupBy("host", "page").agg(F.min_by(F.struct("slots", "own", "linked", "plain"), "whole").alias("of")).select("host", "of.*")
    size = distinct.groupBy("host").agg(F.count("*").alias("of"))
    flat = distinct.select("host", F.explode(F.arrays_zip("slots", "own", "linked", "plain")).alias("s")).select("host", "s.*")
    slots = flat.groupBy("host", "slots").agg(F.count("*").alias("pages"), F.sum("own").alias("own"), F.sum("linked").alias("linked"), F.bool_and("plain").alias("plain"))
    valid = slots.where(F.col("pages") >= LEAST).join(size, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    links = 2 * F.col("linked") >= F.col("own")
    largest = valid.where(~links).groupBy("host").agg(F.max("own").alias("largest"))
    menus = valid.where(links & F.col("plain")).join(largest, "host").where(F.col("largest") > F.col("own")).select("host", "slots")
    of = valid_classes.select("host", "vector", "parent", "repeats", F.explode("tokens").alias("slots"))
    prose = of.where("repeats").join(valid.where(~links).select("host", "slots"), ["host", "slots"]).select("host", F.col("vector").alias("parent"))
    inside = of.join(prose, ["host", "parent"], "left_semi")
    return menus.join(inside, ["host", "slots"], "left_anti").select("host", F.col("slots").alias("text"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text."""
    tokens = page_tokens(pages, url_col, html_col)
    valid = materialise(classes(tokens).select("host", "vector", "tokens", "texts", "parent", "repeats"), "page-classes")
    found = template_texts(tokens, valid).unionByName(menu_slots(tokens, valid))
    texts = materialise(found.withColumnRenamed("host", "of").groupBy("of").agg(F.collect_set("text").alias("template")), "page-templates")
    size = texts.agg(F.sum(F.size("template"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    url_kind = pages.schema[url_col].dataType.simpleString()
    if size <= BROADCAST_TOKENS:
        sent = pages.sparkSession.sparkContext.broadcast({r.of: set(r.template) for r in texts.collect()})
    else:
        sent = None

        def hosts(batches):
            for batch in batches:
                of = [host_of(None if u is None else str(u)) for u in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.string())], ["id", "url", "html", "of"])

        rows = rows.mapInArrow(hosts, f"id {kind}, url {url_kind}, html binary, of string").join(texts, "of", "left").select("id", "url", "html", "template")

    def run(batches):
        for batch in pieces(batches, "html", BATCH_BYTES):
            columns = [c.to_pylist() for c in batch.columns]
            templates = [sent.value.get(host_of(None if u is None else str(u)), set()) for u in columns[1]] if sent else [set(t or ()) for t in columns[3]]
            out = [extract(h.decode("utf-8", "replace") if h else None, t) for h, t in zip(columns[2], templates, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["id", "url", "text"])

    return rows.mapInArrow(run, f"id {kind}, url {url_kind}, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
