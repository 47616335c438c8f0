"""Main text of web pages, without the templates of their sites."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetdelta.llm.common import per_batch
from sheetdelta.session import cut

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select option textarea input label "
    "fieldset iframe object embed svg canvas audio video dialog menu math".split()
)
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption hr address details summary center header footer aside nav form fieldset hgroup".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = BLOCK - frozenset("td th tr thead tbody tfoot caption html body".split())
#: An opening tag ends an open element of these names, unless one of the second set is nearer.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
# Words of class, id and role that mark what does not belong to an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner sidebar "
    "side widget menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottombar cookie cookies "
    "consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations comment comments respond disqus reply replies pagination pager "
    "search form contentinfo complementary toolbar skip".split()
)
KEEPS = frozenset("html body main article".split())
#: Marks that layouts put on wrappers of the article as well.
AMBIGUOUS = frozenset("header form side sidebar search related".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    name: str
    dropped: bool = False
    article: bool = False
    #: the words of MARKS that alone are why it is dropped
    marks: frozenset = frozenset()
    items: list = field(default_factory=list)


def _is_dropped(name: str, attributes: str) -> tuple[bool, bool, frozenset]:
    """Whether an element and all it holds is left out, whether it is marked as main content, and its marks."""
    none: frozenset = frozenset()
    if not attributes or attributes.isspace():
        return False, False, none
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    main = role == "main" or found.get("itemprop", "").lower() == "articlebody"
    if name in KEEPS or main:
        return False, main, none
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True, False, none
    words = _PART.findall(" ".join((found.get("class", ""), found.get("id", ""), role)).lower())
    marks = MARKS.intersection(words)
    return bool(marks), False, marks


def parse(source: str) -> Element:
    """Element tree of a page; broken markup is closed the way browsers do in the usual cases."""
    root = Element("html")
    stack, at = [root], 0
    for token in iter(lambda: _TOKEN.search(source, at), None):
        if token.start() > at:
            stack[-1].items.append(source[at : token.start()])
        at = token.end()
        name = token[2]
        if name is None:
            continue
        name = name.lower()
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
            continue
        if name in ("html", "body"):
            continue
        if name in ENDS_PARAGRAPH:
            _close(stack, frozenset(["p"]), BLOCK - {"p"})
        if name in IMPLIED:
            _close(stack, *IMPLIED[name])
        dropped, main, marks = _is_dropped(name, token[3])
        element = Element(name, dropped, main or name == "article", marks)
        stack[-1].items.append(element)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            element.items.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
        elif name not in VOID and not token[3].endswith("/"):
            stack.append(element)
    if at < len(source):
        stack[-1].items.append(source[at:])
    return root


def _close(stack: list[Element], names: frozenset[str], fence: frozenset[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].name in names:
            del stack[depth:]
            return
        if stack[depth].name in fence:
            return


def _release(root: Element) -> None:
    """Takes back marks of wrappers: of those around the only articles or main, and around most of the text.

    Marks inside an article stay, as do those that hold most of the text without an article
    and are not ambiguous.
    """
    order: list[tuple[Element, int, bool]] = []
    kept = False
    todo = [(root, -1, False, False)]
    while todo:
        now, parent, inside, left = todo.pop()
        left = left or now.dropped
        main = now.article or now.name == "main"
        kept = kept or main and not left
        at = len(order)
        order.append((now, parent, inside))
        inside = inside or now.name == "article"
        todo += [
            (i, at, inside, left) for i in now.items
            if isinstance(i, Element) and i.name not in DROPPED and not (i.dropped and not i.marks)
        ]
    if not any(e.marks and not inside for e, _, inside in order):
        return
    size = [sum(len(i.strip()) for i in e.items if isinstance(i, str)) for e, _, _ in order]
    holds = [False] * len(order)
    for at in range(len(order) - 1, 0, -1):
        now, parent, _ = order[at]
        size[parent] += size[at]
        holds[parent] |= holds[at] or now.article or now.name == "main"
    for at, (now, _, inside) in enumerate(order):
        if now.marks and not inside:
            most = 2 * size[at] > size[0]
            if holds[at] and (most or not kept) or most and now.marks <= AMBIGUOUS:
                now.dropped = False


def _scopes(element: Element, inside: bool = False) -> Iterator[Element]:
    """Outermost article elements that are not left out."""
    todo = [element]
    while todo:
        now = todo.pop()
        if now.article:
            yield now
            continue
        todo += [i for i in reversed(now.items) if isinstance(i, Element) and not (i.dropped or i.name in DROPPED)]


@dataclass
class Block:
    text: str
    #: hashes of the block elements around the text, innermost first
    within: list[int]


def blocks(scope: Element) -> list[Block]:
    """Text blocks in page order, each with the hashes of the subtrees it lies in.

    The hash of a subtree covers its element name and texts. The scope itself is none. A
    header inside an article may hold its headline; one of the page does not.
    """
    out: list[Block] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(Block(text, []))

    # depth first without recursion, as pages may nest deeply
    stack: list[tuple[Element, Iterator, int]] = [(scope, iter(scope.items), 0)]
    while stack:
        element, items, first = stack[-1]
        item = next(items, None)
        if item is None:
            stack.pop()
            if element.name in BLOCK:
                flush()
                own = out[first:]
                if own and stack:
                    made = xxhash.xxh64_intdigest(f"{element.name}\x00" + "\x01".join(b.text for b in own)) - (1 << 63)
                    for b in own:
                        b.within.append(made)
        elif isinstance(item, str):
            run.append(item)
        elif item.name == "br":
            run.append(" ")
        elif item.dropped and not (scope.article and item.marks == {"header"} and _holds_heading(item)):
            continue
        elif item.name in DROPPED and not (scope.article and item.name == "header" and _holds_heading(item)):
            continue
        else:
            if item.name in BLOCK:
                flush()
            stack.append((item, iter(item.items), len(out)))
    flush()
    return out


def _holds_heading(element: Element) -> bool:
    return any(isinstance(i, Element) and (i.name in HEADINGS or i.name in ("div", "hgroup") and _holds_heading(i)) for i in element.items)


def main_blocks(source: str) -> list[Block]:
    """Blocks of the article: of the longest article element, else of main, else of the whole page."""
    root = parse(source)
    _release(root)
    found = [blocks(s) for s in _scopes(root)]
    if found:
        return max(found, key=lambda bs: sum(len(b.text) for b in bs))
    mains = [e for e in _elements(root) if e.name == "main"]
    return blocks(mains[0] if mains else root)


def _elements(root: Element) -> Iterator[Element]:
    todo = [root]
    while todo:
        now = todo.pop()
        yield now
        todo += [i for i in now.items if isinstance(i, Element) and not (i.dropped or i.name in DROPPED)]


def extract_pages(
    pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", least_pages: int = 8, share: float = 0.6,
) -> DataFrame:
    """Main text of every page: key, url, text, n_chars.

    Rules by element and attribute pick the article. Subtrees inside it are hashed and
    counted per host over its different articles; those in at least ``least_pages`` of them
    and in ``share`` of them are the site's template and are deleted. Copies of an article
    count once, so a page that is copied often is no template. Null and empty pages have an
    empty text; pages without a host keep all subtrees; repeated rows keep a row each; other
    columns are not read.
    """
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (key, url))
    host = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    plain = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(host, F.lit("")).alias("host"),
        F.col(source).cast("string").alias("html"),
    ).withColumn("page", F.xxhash64("key", "url", "html"))

    def read(batch) -> dict[str, object]:
        texts, within, articles = [], [], []
        for value in batch.column(3).to_pylist():
            found = main_blocks(value or "")
            texts.append([b.text for b in found])
            within.append([b.within for b in found])
            articles.append(xxhash.xxh64_intdigest("\n".join(texts[-1])) - (1 << 63))
        return {
            "key": batch.column(0), "url": batch.column(1), "host": batch.column(2), "page": batch.column(4),
            "article": articles, "texts": texts, "within": within,
        }

    schema = f"key {kind}, url {url_kind}, host string, page long, article long, texts array<string>, within array<array<long>>"
    parsed = cut(per_batch(plain, read, schema))
    seen = parsed.filter("host <> ''").select("host", "page", "article", F.explode(F.array_distinct(F.flatten("within"))).alias("subtree"))
    counted = seen.select("host", "article", "subtree").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    hosts = parsed.filter("host <> ''").select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("articles"))
    template = counted.join(hosts, "host").filter(F.col("n") >= share * F.col("articles")).select("host", "subtree")
    # written first, so that its true size decides whether the texts are shuffled for the join
    marked = cut(seen.join(template, ["host", "subtree"], "left_semi").groupBy("page").agg(F.collect_set("subtree").alias("template")))
    joined = parsed.join(marked, "page", "left")
    kept = F.filter(
        F.arrays_zip("texts", "within"), lambda b: ~F.coalesce(F.arrays_overlap(b["within"], F.col("template")), F.lit(False))
    )
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), "\n")
    return joined.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
