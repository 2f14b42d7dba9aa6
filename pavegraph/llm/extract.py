"""Main text of web pages with a site style tree.

The element trees of all pages of a host are merged by path: an element's style is its tag with class and id, its path
the styles from the root down. For each path of a host two entropies are taken over its pages, that of the texts in it
(content) and that of the sequences of child styles (presentation), each relative to the most they could be. A page
counts once for a path, with all that it has there taken together; inline elements are never judged. Branches
whose combined importance is low say the same on page after page and go. What HTML itself says is no content (nav,
footer, form, scripts, what is hidden) and comments of readers are left out of the tree; all else is in it. Class names
like those of adverts, menus and boxes are a prior: they stand for so many pages on which the branch was unimportant, so
they decide where few pages were seen, and the entropies where there are many. What a page marks as its main content (main,
role=main, article) is judged too, but more mildly and relative to the importance of that element: an article copied to
other pages of the host is still its article, while a box that is the same in different articles is none of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Paths to remove that are broadcast to all tasks, after counting; more of them are joined by host in a shuffle.
BROADCAST_PATHS = 1_000_000
#: A branch below this importance is removed.
IMPORTANCE = 0.5
#: Entropies of few pages say little: importance is that of the pages seen and of so many more that all differ.
PRIOR_PAGES = 8
#: A name like noise counts as so many pages on which the branch had no importance; a soft name within main content as
#: PRIOR_PAGES of half the importance.
NAMED_PAGES = 400
#: Share of presentation in the importance of a branch; the rest is content.
PRESENTATION = 0.2
#: Inside a main element the importance of a branch is multiplied by this and divided by that of the element.
MAIN = 2.0

MARKUP = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; their text is never part of a page.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("body br head html legend li dd dt option summary tbody td tfoot th thead tr figcaption".split())
#: A new one ends an open one of the group, up to the list or table around it.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
AROUND = frozenset("ul ol menu dl table select".split())
NOISE_TAGS = frozenset("nav footer aside form button select dialog menu svg object audio video canvas head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

def _names(*words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words)})(?:$|[\s_-])", re.I)


#: Names of readers' comments, of what is no content, and of what may be content within an article.
COMMENT_NAMES = _names("comments?", "disqus", "replies", "respond")
NOISE_NAMES = _names("nav", "navbar", "navigation", "menu", "breadcrumbs?", "sidebar", "footer", "masthead", "site-header", "page-header", "topbar", r"ads?", r"advert\w*", r"sponsor\w*", r"promo\w*", "cookies?", "consent", "gdpr", "popup", "modal", "newsletter", r"subscri\w*", "signup", "login", "pagination", "pager")
SOFT_NAMES = _names("banner", "notice", "alert", "overlay", "share", "sharing", "social", "related", r"recommend\w*", "widget", "toolbar")
#: How much a branch is named like noise: not, softly, or plainly.
UNNAMED, SOFT, PLAIN = 0, 1, 2
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "style", "noise", "named", "main", "children", "path")

    def __init__(self, tag: str, attributes: str, parent: Element | None) -> None:
        self.tag, self.children = tag, []
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role = found.get("role", "").lower()
        marked = tag == "main" or role == "main"
        free = tag not in ("html", "body") and not marked
        self.named = UNNAMED if not names or not free else PLAIN if NOISE_NAMES.search(names) else SOFT if SOFT_NAMES.search(names) else UNNAMED
        self.main = marked or tag == "article" and not self.named
        inside = parent is not None and parent.tag in ("article", "section", "main")
        self.noise = tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in found or tag == "header" and not inside or free and bool(names and COMMENT_NAMES.search(names) or HIDDEN.search(found.get("style", "")))
        self.style = f"{tag}.{DIGITS.sub('0', names)}" if names else tag
        if marked and tag != "main":
            self.style += "[main]"
        self.path = xxhash.xxh64_intdigest(self.style, parent.path if parent is not None else 0)


def parse(page: str) -> Element:
    """The element tree; children are elements and strings, raw elements have none, unclosed and stray tags are borne."""
    root = Element("html", "", None)
    stack = [root]
    at, size = 0, len(page)
    held: Counter = Counter()  # open elements by tag

    def pop_to(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        if not any(held[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                held.subtract(e.tag for e in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not held["p"]:
                continue
            pop_to((tag,), frozenset(("article", "main", "table", "body")) - {tag} if tag not in BLOCK else frozenset())
            continue
        if tag == "html" or tag == "body" and held["body"]:
            continue
        if tag in ENDS_P:
            pop_to(("p",), ENDS_P - {"p"})
        if tag in SIBLINGS:
            pop_to(SIBLINGS[tag], AROUND)
            if tag == "tr":
                pop_to(("tr",), AROUND)
        if tag == "body":
            pop_to(("head",), frozenset())
        node = Element(tag, m[3], stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
            held[tag] += 1
    return root


def text_of(node: Element, low: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of a branch without its noise and its unimportant branches, but with main elements in those of the latter that are not named."""
    out: list[str] = []
    stack = [(iter(node.children), False, False)]
    while stack:
        children, gone, block = stack[-1]
        for c in children:
            if isinstance(c, str):
                if not gone:
                    out.append(html.unescape(c))
                continue
            if c.tag in BLOCK:
                out.append(" ")
            if c.tag not in RAW and not c.noise and not (c.named and c.path in low):
                stack.append((iter(c.children), c.path in low or gone and not c.main, c.tag in BLOCK))
                break
            if c.tag in BLOCK:
                out.append(" ")
        else:
            stack.pop()
            if block:
                out.append(" ")
    return " ".join("".join(out).split())


def main_text(page: str, low: frozenset[int] | set[int] = frozenset()) -> str:
    return text_of(parse(page), low)


def style_nodes(page: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(path, main, named, content, presentation) of each path with text in block or named elements, as numbers; all that a page has at a path is one.

    ``main`` is the path of the outermost main element that holds the element or is it, else 0. Noise is left out.
    """
    found: dict[int, tuple[int, int, xxhash.xxh64, xxhash.xxh64]] = {}
    root = parse(page)
    stack = [(root, iter(root.children), 0, xxhash.xxh64(), [])]
    some = [False]  # by level: whether there is text
    while stack:
        e, children, main, own, styles = stack[-1]
        for c in children:
            if isinstance(c, str):
                if c.strip():
                    own.update(" ".join(c.split()))
                    some[-1] = True
            elif c.tag not in RAW and not c.noise:
                styles.append(c.style)
                stack.append((c, iter(c.children), main or (c.path if c.main else 0), xxhash.xxh64(), []))
                some.append(False)
                break
        else:
            stack.pop()
            if some.pop():
                if e.tag in BLOCK or e.named:
                    *_, content, presentation = found.setdefault(e.path, (main, e.named, xxhash.xxh64(), xxhash.xxh64()))
                    content.update(own.digest())
                    presentation.update("\n".join(styles) + "\0")
                if stack:
                    stack[-1][3].update(own.digest())
                    some[-1] = True
    return ((path, main, named, content.intdigest(), presentation.intdigest()) for path, (main, named, content, presentation) in found.items())


def host_of(column):
    """The host in a URL, in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(column, r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def style_tree(pages: DataFrame, prior: int = PRIOR_PAGES, named_pages: int = NAMED_PAGES) -> DataFrame:
    """(host, path, main, named, pages, importance) of the merged trees; ``pages``: (host, html), ``main`` as in style_nodes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                seen: Counter = Counter()
                for host, page in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns)):
                    for path, main, named, content, presentation in style_nodes(page):
                        seen[host, path, main, named, 0, content] += 1
                        seen[host, path, main, named, 1, presentation] += 1
                columns = list(zip(*seen)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), _signed(columns[1]), _signed(columns[2]), *(pa.array(c, pa.int32()) for c in columns[3:5]), _signed(columns[5]), pa.array(list(seen.values()), pa.int64())], names=["host", "path", "main", "named", "kind", "feature", "n"])

    counted = pages.mapInArrow(count, "host string, path long, main long, named int, kind int, feature long, n long").groupBy("host", "path", "main", "named", "kind", "feature").agg(F.sum("n").alias("n"))
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    by_kind = counted.groupBy("host", "path", "main", "named", "kind").agg(F.sum("n").alias("m"), F.when(F.sum("n") > 1, entropy / F.log(F.sum("n"))).otherwise(1.0).alias("e"))
    both = F.sum(F.col("e") * F.when(F.col("kind") == 1, PRESENTATION).otherwise(1 - PRESENTATION))
    pages_ = F.max("m")
    soft = (F.col("named") == SOFT) & (F.col("main") != 0)
    more = F.when((F.col("named") == UNNAMED) | soft, prior).otherwise(named_pages)
    good = F.when(F.col("named") == UNNAMED, 1.0).when(soft, 0.5).otherwise(0.0)
    return by_kind.groupBy("host", "path", "main", "named").agg(pages_.alias("pages"), ((both * pages_ + more * good) / (pages_ + more)).alias("importance"))


def unimportant(tree: DataFrame, importance: float = IMPORTANCE) -> DataFrame:
    """(host, path) of the branches to remove; a main element is never one."""
    judged = tree.filter((F.col("importance") < importance) & (F.col("path") != F.col("main")))
    mains = tree.filter("path = main").select(F.col("host").alias("_host"), F.col("path").alias("_main"), F.col("importance").alias("around"))
    inside = judged.filter("main != 0").join(mains, (F.col("host") == F.col("_host")) & (F.col("main") == F.col("_main")))
    inside = inside.filter((F.col("named") != UNNAMED) | (F.col("importance") * MAIN < F.col("around") * importance))
    return judged.filter("main = 0").select("host", "path").union(inside.select("host", "path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", importance: float = IMPORTANCE, prior: int = PRIOR_PAGES) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points of the text).

    The text is that of the page without menus, page headers, footers, asides, forms, comments and hidden parts, and
    without branches of low importance on the host, main elements in these excepted. Branches named like adverts,
    sidebars and so on have little importance unless many pages show that they differ; within an article, names that may
    be content (notice, related, ...) leave it to the pages. References are decoded, white space is one space, blocks are joined by one space. The fewer pages a branch is on, the less its
    sameness counts (PRIOR_PAGES). Null html counts as empty and gives an empty text; pages without a host are one site. Repeated rows are
    pages each for itself; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    tree = table(style_tree(rows.select("host", "html"), prior))
    low = unimportant(tree, importance).groupBy("host").agg(F.collect_list("path").alias("low"))
    low = table(low)
    few = (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_PATHS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                hosts, pages_, texts = part.column(2).to_pylist(), part.column(3).to_pylist(), []
                for k, (host, page) in enumerate(zip(hosts, pages_)):
                    if host not in known:
                        known = {host: frozenset(np.array(part.column(4)[k].as_py() or [], np.int64).view(np.uint64).tolist())} | (known if len(known) < 100 else {})
                    texts.append(main_text(page, known[host]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    joined = rows.join(F.broadcast(low) if few else low, "host", "left").select("id", "url", "host", "html", "low")
    return joined.mapInArrow(run, f"`{id_col}` long, url string, text string, n_chars long")
