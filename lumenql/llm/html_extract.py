"""Operator 10: main text of web pages by composite text density."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches

# The element names of the HTML standard that matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never part of an article.
BOILER = frozenset("head script style noscript template nav header footer aside form button select option textarea input iframe svg math canvas object embed audio video map dialog menu title noframes fieldset datalist".split())
BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words of class and id that name what surrounds an article.
BOILER_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion form search pagination pager widget copyright legal disclaimer toolbar".split()
)
#: Words that stand beside those in a compound and leave its meaning, as in main-nav or comments-list.
BESIDE_WORD = frozenset(
    "site page main global local top bottom left right upper lower center primary secondary inner outer first last mobile desktop fixed sticky floating "
    "wrap wrapper container holder box area section region block panel zone slot row col column bar inline list lists item items group unit units link links button buttons btn icon icons "
    "title heading head text body content message messages thread post posts article articles story entry blog news author user profile media image video google dfp html js css id the and or of to by for us "
    "index archive category tag tags latest popular more next prev previous follow counter count toggle drop down dropdown mega sub lang language ui app web wp module component view sponsoring external".split()
)
#: Elements that an article has or is.
MARKS = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that end an open p, and what each kind of item ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
CUT_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)>)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "up", "kids", "skip", "named", "plain", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag, up, skip):
        self.tag, self.up, self.skip = tag, up, skip
        self.kids = []
        self.named = False


def names_boiler(value: str) -> bool:
    """Whether a token of a class or id is a boiler word, or a compound of such words and those beside them only."""
    for token in value.split():
        found = WORDS.findall(token)
        if not BOILER_WORD.isdisjoint(found) and all(w in BOILER_WORD or w in BESIDE_WORD or len(w) == 1 for w in found):
            return True
    return False


def boiler(tag: str, attributes: str) -> bool | str:
    """Whether an element is not part of an article by its name or role; "named" if by words of its class or id only."""
    named = False
    if tag in BOILER:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        before = attributes[m.start() - 1 : m.start()]
        if before and not before.isspace() and before not in "\"'/":
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in BOILER_ROLE:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and names_boiler(value):
            named = "named"
    return named


def parse(page: str) -> Node:
    """Element tree of a page; unclosed and stray tags as browsers take them, references still encoded."""
    root = Node("#root", None, False)
    at, now, n = 0, root, len(page)
    low = None
    opened: Counter = Counter()  # open elements by name, so that a search for one that is not open ends at once

    def close(to: Node) -> Node:
        x = now
        while x is not to:
            opened[x.tag] -= 1
            x = x.up
        return to

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            now.kids.append(page[at:])
            break
        m = TAG.match(page, lt) or CUT_TAG.match(page, lt)
        if not m:
            if re.match(r"<[/!?a-zA-Z]", page[lt : lt + 2]):  # a tag that the page's end cuts
                if lt > at:
                    now.kids.append(page[at:lt])
                break
            now.kids.append(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            now.kids.append(page[at:lt])
        if m[1]:
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        at = m.end()
        if m[2]:
            if m[2] in "!?":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        tag = m[4].lower()
        if m[3]:
            if opened[tag]:
                x = now
                while x.tag != tag:
                    x = x.up
                now = close(x.up)
            elif tag == "p":
                now.kids.append(Node("p", now, False))
            continue
        if tag in ENDS_P and opened["p"]:
            x = now
            while x is not root and (x.tag in INLINE or x.tag == "p"):
                if x.tag == "p":
                    now = close(x.up)
                    break
                x = x.up
        if tag in ENDS_SAME and any(opened[t] for t in ENDS_SAME[tag][0]):
            ends, within = ENDS_SAME[tag]
            x = to = now
            while x is not root and x.tag not in within:
                if x.tag in ends:
                    to = x.up
                x = x.up
            now = close(to)
        why = boiler(tag, m[5])
        node = Node(tag, now, bool(why))
        node.named = why == "named"
        now.kids.append(node)
        if tag in RAW:
            if low is None:
                low = page.lower()
            end = low.find("</" + tag, at)
            if end < 0:
                end = n
            node.kids.append(page[at:end])
            gt = page.find(">", end)
            at = n if gt < 0 else gt + 1
        elif tag not in VOID and not m[5].endswith("/"):
            now = node
            opened[tag] += 1
    return root


def visible(text: str) -> int:
    return len(SPACE.sub("", text))


def measure(root: Node) -> list[Node]:
    """Counts characters, link characters, tags and link tags of each subtree; returns the nodes, parents first."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if isinstance(k, Node) and not k.skip]
    for x in reversed(order):
        x.chars = x.links = x.link_tags = 0
        x.tags = 0
        for k in x.kids:
            if isinstance(k, str):
                x.chars += visible(k)
            elif not k.skip:
                x.chars += k.chars
                x.links += k.links
                x.tags += k.tags + (k.tag not in INLINE or k.tag == "a")
                x.link_tags += k.link_tags + (k.tag == "a")
        if x.tag == "a":
            x.links = x.chars
    return order


def densities(root: Node) -> list[Node]:
    """Sets the composite density of each node and the sum over its children.

    A node's density is its characters a tag, times the logarithm of that (and of its text against its links) to a
    base that grows with the share of links: text with few links counts most. Text that stands directly in a node
    counts as a child without tags.
    """
    from math import e, log

    order = measure(root)
    share = root.links / max(1, root.chars)
    for x in order:
        c, lc, t, lt = x.chars, x.links, max(1, x.tags), max(1, x.link_tags)
        plain = c - lc
        base = log(max(1.0, c / max(1, plain) * lc + share * c) + e)
        x.density = c / t * log(1 + c / max(1, lc) * t / lt) / log(max(1.0, base) + 1) if plain > 0 else 0.0
    for x in order:
        own = sum(visible(k) for k in x.kids if isinstance(k, str))
        x.total = own + sum(k.density for k in x.kids if isinstance(k, Node) and not k.skip)
    return order


def main_nodes(root: Node) -> list[Node | str]:
    """What makes the article, in page order: subtrees, and texts that stand directly in a node above them.

    From the node with the largest density sum, the path to the body is followed; the smallest density on it is the
    threshold of the page. If an article (or main) element stands around that node, or inside it with most of its text,
    it is the article. Otherwise the node's subtree is, with all that hangs on the path and has at least the threshold
    density and less links than text, and with headings that stand right before such.
    """
    order = densities(root)
    if not root.chars:
        return []
    best = max(order, key=lambda x: x.total)
    while best.up is not None and best.tag in INLINE:
        best = best.up
    for tag in MARKS:
        x = best
        while x is not None and x.tag != tag:
            x = x.up
        if x is not None:
            return [x]
    for tag in MARKS:
        inside = [x for x in order if x.tag == tag and under(x, best)]
        if inside and 2 * (x := max(inside, key=lambda x: x.chars - x.links)).chars > best.chars:
            return [x]
    path = [best]
    while path[-1].up is not None and path[-1].tag != "body":
        path.append(path[-1].up)
    threshold = min(x.density for x in path)
    found: list[Node | str] = [best]
    if best.tag in ("body", "html", "#root"):  # the page itself: all of it but what is mostly links
        found = [k for k in best.kids if isinstance(k, str) or k.skip or k.density >= threshold or 2 * k.links < k.chars]
    for below, above in zip(path, path[1:], strict=False):
        at = next(i for i, k in enumerate(above.kids) if k is below)
        enough = lambda k: visible(k) >= max(threshold, 1) if isinstance(k, str) else not k.skip and k.chars > 0 and k.density >= threshold and 2 * k.links < k.chars  # noqa: B023, E731
        before, after = [], [k for k in above.kids[at + 1 :] if enough(k)]
        follows = True  # whether what stands behind is taken
        for k in reversed(above.kids[:at]):
            if isinstance(k, str) and not visible(k):
                continue
            follows = enough(k) or follows and isinstance(k, Node) and not k.skip and k.tag in HEADINGS and 2 * k.links < k.chars
            if follows:
                before.append(k)
        found = [*reversed(before), *found, *after]
    return found


def under(x: Node, top: Node) -> bool:
    while x is not None and x is not top:
        x = x.up
    return x is top


def spare(root: Node) -> None:
    """Takes back the skip of elements named as boiler that density puts around the article, or that hold most of the page's unlinked text.

    The first are those above the subtree that has the largest density sum when they are all taken in. Only if no article
    or main stands outside of them, nor an h1 if they have none: long comments beside an article stay out.
    """
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if isinstance(k, Node) and (not k.skip or k.named)]
    named = [x for x in order if x.named]
    if not named:
        return
    for x in named:
        x.skip = False
    best = max(densities(root), key=lambda x: x.total)
    for x in named:
        x.skip = True
    for x in reversed(order):
        x.plain = 0 if x.tag == "a" else sum(visible(k) if isinstance(k, str) else k.plain for k in x.kids if isinstance(k, str) or not k.skip or k.named)
    for x in named:  # parents first
        if 2 * x.plain > root.plain or under(best, x):
            seen = {y.tag for y in measure(root)}
            if seen.isdisjoint(MARKS) and ("h1" not in seen or any(y.tag == "h1" and under(y, x) for y in order)):
                x.skip = False


def blocks(tops: list[Node | str]) -> list[str]:
    """Texts of the blocks of nodes and texts in page order, references decoded, white space inside a block as one space."""
    out, now = [], []

    def end():
        if now:
            text = SPACE.sub(" ", html.unescape("".join(now))).strip(" ")
            if text:
                out.append(text)
            now.clear()

    todo = [*reversed(tops)]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.skip:
            if x.tag not in INLINE:
                end()
        elif x.tag in INLINE:
            todo += reversed(x.kids)
        else:
            end()
            todo.append(None)
            todo += reversed(x.kids)
    end()
    return out


def main_text(page: str | None) -> str:
    """Main text of a page; empty for null, empty or text-free pages."""
    if not page:
        return ""
    root = parse(page)
    spare(root)
    return " ".join(blocks(main_nodes(root)))


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points) for html; whole pages, row by row, no shuffle.

    Null html counts as empty and gives an empty text, as do pages without text; an empty table gives no rows, and
    repeated rows are extracted each for itself. Columns named text or n_chars are replaced, all others stay.
    """
    keep = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    d = pages.select(*keep, html_column)
    schema = d.drop(html_column).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for x in batches:
            for at in range(0, len(x), 256):
                part = x.slice(at, 256)
                texts = [main_text(v) for v in part.column(len(keep)).to_pylist()]
                arrays = [part.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "text", "n_chars"])

    return d.mapInArrow(run, schema)


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
