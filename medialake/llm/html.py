"""HTML extraction (operator 8): main text, with site templates removed.

Each page is parsed into a tree of elements (optional end tags and unclosed
elements are handled as browsers do in the common cases). Menus, page headers,
footers, sidebars, notices, adverts, forms, comments, scripts and styles are
recognized by element, role, and class or id names, and left out; an
``article``, else ``main``, else the body is the main part. Names must match
as a whole (``sidebar``, ``site-footer``, not ``has-sidebar``), and neither a
name nor a form takes out what holds the main part or most of the text.

What a site repeats without such marks is found by counting: every container
subtree left in the main part is hashed (tags and text), and Spark counts per
host on how many different pages it stands. Subtrees that recur on many pages
are removed, but never one that holds most of a page's text. Equal pages count once, so the text of an article that is
published at many addresses is not taken for a template, and inside an
``article`` or ``main`` only containers (not paragraphs or headings) can be.

Pages are parsed once. What is stored are the text blocks of the main part,
each with the hashes of the containers around it; only pages that have such
containers take part in the join with the host's templates.
"""

from __future__ import annotations

import html as _html
import re
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm import rows as R
from medialake.session import materialize

#: A subtree is a template from this many different pages and this share of a host's different pages,
MIN_PAGES, MIN_SHARE = 5, 0.1
#: or from this many different pages, however large the host is. In a marked main part only what looks
#: like furniture can be one: boxes and lists that are mostly links, and boxes that open or end the
#: part; if they hold prose (text of this length that is no link), by the latter number only.
MANY_PAGES, PROSE = 50, 200
BOXES = frozenset("div section center header".split())
# of rolling hashes over blocks
_BASE, _PRIME = 0x5851F42D4C957F2D, (1 << 61) - 1

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option summary tbody td tfoot th thead tr li dd dt".split())
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg math canvas nav aside footer button select "
    "textarea input dialog menu title audio video noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
CONTAINERS = frozenset("div section ul ol dl table figure details center fieldset blockquote header".split())

# Class and id names of page furniture. A name is one or more of the words of a
# line, perhaps with one of the words before or after it.
COMMENT_WORDS = frozenset("comment comments disqus replies".split())
#: of lists whose entries may be ``article`` elements of their own
LIST_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar sidebars related "
    "recommended".split())
FURNITURE = COMMENT_WORDS | LIST_WORDS | frozenset(
    "banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager share sharing social footer masthead topbar "
    "toolbar login searchform searchbox skip".split())
MAIN_ONLY_OUTSIDE = frozenset("header head".split())
BEFORE = frozenset("site main top bottom global primary secondary left right page post entry article".split())
AFTER = frozenset(
    "area bar block box button buttons container form icons inner item items link links list message module panel posts "
    "articles section slot stories unit widget wrap wrapper".split())

#: What an element is by its own marks: always left out; left out unless it holds the main part or most of the text.
HARD, SOFT, LIST, COMMENTS, HEADER = 1, 2, 3, 4, 5
IN_ARTICLE, IN_MAIN = 1, 2

# a quote opens a string after an equals sign only
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>")
_ATTR = re.compile(r"([a-zA-Z][\w-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "attrs", "children", "kind", "size", "holds")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.kind = self.size = self.holds = 0


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(raw)} if raw.strip(" /\n\t\r") else {}


class _Stack(list):
    """Open elements, with their number by name: most questions about them need
    no look along the stack."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: dict[str, int] = {}

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def cut(self, i: int) -> None:
        for node in self[i:]:
            self.open[node.tag] -= 1
        del self[i:]


def parse(text: str | None) -> Node:
    """Element tree; children are Nodes and (undecoded) strings."""
    root = Node("#root")
    stack, at, n = _Stack(root), 0, len(text or "")
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            stack[-1].children.append(text[at:])
            break
        if lt > at:
            stack[-1].children.append(text[at:lt])
        nxt = text[lt + 1:lt + 2]
        if text.startswith("<!--", lt):
            short = re.compile(r"-?>").match(text, lt + 4)  # ends at once
            end = text.find("-->", lt + 4)
            at = short.end() if short else n if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = text.find(">", lt)
            at = n if end < 0 else end + 1
        elif nxt.isalpha() or (nxt == "/" and text[lt + 2:lt + 3].isalpha()):
            m = _TAG.match(text, lt)
            if not m:  # a tag cut off at the end
                break
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                _close(stack, tag)
            else:
                _open(stack, tag, m[3])
                if tag in RAW and stack[-1].tag == tag:
                    end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(text, at)
                    stop = end.start() if end else n
                    if tag not in ("script", "style"):
                        stack[-1].children.append(text[at:stop])
                    at = stop
        else:
            stack[-1].children.append("<")
            at = lt + 1
    return root


_SCOPE = frozenset("#root html table td th caption object template".split())
_SIBLINGS = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))),
             "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))),
             "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select", "optgroup"))),
             "tbody": ("thead tbody tfoot tr td th", frozenset(("table",))),
             "tfoot": ("thead tbody tfoot tr td th", frozenset(("table",)))}


def _open(stack: _Stack, tag: str, attrs: str) -> None:
    if tag in CLOSES_P and stack.open.get("p"):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                stack.cut(i)
                break
            if stack[i].tag in _SCOPE or stack[i].tag in BLOCK:
                break
    if tag in _SIBLINGS:
        names, inside = _SIBLINGS[tag]
        names = names.split()
        for i in range(len(stack) - 1, 0, -1) if any(stack.open.get(x) for x in names) else ():
            if stack[i].tag in inside:
                break
            if stack[i].tag in names:
                stack.cut(i)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
    node = Node(tag, attrs)
    stack[-1].children.append(node)
    if tag not in VOID and not attrs.rstrip().endswith("/") or tag in RAW:
        if tag not in VOID:
            stack.push(node)


def _close(stack: _Stack, tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1) if stack.open.get(tag) else ():
        if stack[i].tag == tag:
            stack.cut(i)
            return
        # an inline end tag does not close blocks; a block's does not leave its cell
        if tag not in BLOCK and stack[i].tag in BLOCK or stack[i].tag in ("td", "th") and tag not in (
                "table", "tr", "tbody", "thead", "tfoot", "html", "body", "article", "main"):
            return


def _named(name: str) -> int:
    """The kind that a class or id name stands for, 0 for none."""
    parts = [p.lower() for p in _TOKEN.findall(name)]
    while len(parts) > 1 and (parts[-1].isdigit() or parts[-1] == "x"):
        parts.pop()
    if len(parts) > 1 and parts[0] in BEFORE:
        parts = parts[1:]
    if len(parts) > 1 and parts[-1] in AFTER:
        parts = parts[:-1]
    if not parts or any(p not in FURNITURE and p not in MAIN_ONLY_OUTSIDE for p in parts):
        return 0
    if any(p in COMMENT_WORDS for p in parts):
        return COMMENTS
    if any(p in LIST_WORDS for p in parts):
        return LIST
    return SOFT if any(p in FURNITURE for p in parts) else HEADER


def _kind(node: Node) -> int:
    """What an element is by its own marks, 0 for a part of the text."""
    tag = node.tag
    if tag in DROPPED:
        return HARD
    kind = SOFT if tag == "form" else HEADER if tag == "header" else 0
    if not node.attrs.strip(" /\n\t\r"):
        return kind
    a = _attributes(node.attrs)
    role = a.get("role", "").lower()
    if role in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return HARD
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return HARD
    if tag in ("html", "body", "article", "main", "h1"):
        return 0
    if role == "form":
        kind = SOFT
    found = [k for x in (a.get("class", ""), a.get("id", "")) for name in x.split() if (k := _named(name))]
    return next((k for k in (COMMENTS, LIST, SOFT, HEADER) if k in found), kind)


def _is_main(node: Node) -> bool:
    return node.tag == "main" or "role" in node.attrs and _attributes(node.attrs).get("role") == "main"


def _weigh(root: Node) -> None:
    """Kinds, and what each element holds outside of what is always left out:
    characters of text, ``article`` and ``main`` elements."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.kind = _kind(node) if node is not root else 0
        if node.kind != HARD:
            order.append(node)
            todo.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        node.holds = IN_ARTICLE * (node.tag == "article") | IN_MAIN * _is_main(node)
        for c in node.children:
            if isinstance(c, Node):
                node.size += c.size
                node.holds |= c.holds
            else:
                node.size += len(c.strip())


def furniture(node: Node, total: int, in_main: bool) -> bool:
    """Whether a weighed element is none of the main text, in a part or page
    of ``total`` characters."""
    if node.kind in (0, HARD):
        return node.kind == HARD
    if node.kind == HEADER and in_main or node.holds & IN_MAIN or node.holds and node.kind in (SOFT, HEADER):
        return False
    return 2 * node.size <= total or node.kind == COMMENTS and in_main


def _main_parts(root: Node) -> tuple[list[Node], bool]:
    """Outermost ``article`` elements, else ``main`` elements, else those that
    stand in lists and comments only, else the whole."""
    _weigh(root)
    for lists in (False, True):
        for wanted, mask in (("article", IN_ARTICLE), ("main", IN_MAIN)):
            out, todo = [], [root]
            while todo:
                node = todo.pop()
                if not node.holds & mask:
                    continue
                if node is not root:
                    if not lists and (furniture(node, root.size, False) or node.kind == COMMENTS and not node.holds & IN_MAIN):
                        continue
                    if node.tag == wanted or wanted == "main" and _is_main(node):
                        out.append(node)
                        continue
                todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
            if out:
                return out, True
    return [root], False


def _squeeze(parts: list[str]) -> str:
    return " ".join(_html.unescape("".join(parts)).split())


def main_blocks(text: str | None) -> list[tuple[str, list[int]]]:
    """Text blocks of the main part in page order, each with the hashes of the
    removable subtrees around it."""
    parts, marked = _main_parts(parse(text))
    out: list[tuple[str, list[int]]] = []
    for part in parts:
        _walk(part, marked, out)
    # what holds most of the text is no template
    total, size = sum(len(t) for t, _ in out), {}
    for t, subs in out:
        for x in set(subs):
            size[x] = size.get(x, 0) + len(t)
    return [(t, [x for x in subs if 2 * size[x] <= total]) for t, subs in out]


def _walk(part: Node, marked: bool, out: list[tuple[str, list[int]]]) -> None:
    """Depth-first without recursion, so nesting depth is no limit. The subtrees
    given with a block are those that a template may be: in a marked part, boxes
    and lists of links, and boxes at its start or end."""
    blocks: list[list] = []  # [text, open subtrees]
    sums, lengths = [0], [0]  # of the blocks so far
    run: list[str] = []
    # of subtrees: [first block, signature, hash, link text before, block after, mostly links, is a box]
    opened: list[list] = []
    inside = linked = 0  # links around, characters of link text

    def flush() -> None:
        t = _squeeze(run)
        run.clear()
        if t:
            blocks.append([t, list(opened)])
            sums.append((sums[-1] * _BASE + xxhash.xxh3_64_intdigest(t)) % _PRIME)
            lengths.append(lengths[-1] + len(t) + 1)

    todo: list[tuple[object, bool]] = [(part, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            run.append(node)
            linked += len(node.strip()) if inside else 0
            continue
        removable = node is not part and (node.tag in CONTAINERS or not marked and node.tag in BLOCK)
        if leaving:
            if node.tag in BLOCK:
                flush()
            inside -= node.tag == "a"
            if removable:
                sub, end = opened.pop(), len(blocks)
                first = sub[0]
                length = lengths[end] - lengths[first]
                sub[4:] = end, 2 * (linked - sub[3]) >= length, node.tag in BOXES
                text = (sums[end] - sums[first] * pow(_BASE, end - first, _PRIME)) % _PRIME
                prose = marked and not sub[5] and length - (linked - sub[3]) > PROSE
                # the last bit tells prose
                sub[2] = (xxhash.xxh3_64_intdigest(f"{sub[1]}\x00{text} {length}") - (1 << 63)) & ~1 | prose
            continue
        if node is not part and furniture(node, part.size, marked):
            if node.tag in BLOCK:
                flush()
            else:
                run.append(" ")
            continue
        if node.tag == "br":
            run.append(" ")
            continue
        if node.tag in BLOCK:
            flush()
        if removable:
            opened.append([len(blocks), f"{node.tag} {' '.join(c.tag for c in node.children if isinstance(c, Node))}", 0, linked, 0, False, False])
        inside += node.tag == "a"
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(node.children))
    flush()
    last = len(blocks)
    out.extend((t, [s[2] for s in subs if not marked or s[5] or s[6] and (s[0] == 0 or s[4] == last)]) for t, subs in blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _parse_udf():
    @F.pandas_udf("host string, blocks array<struct<text:string,subs:array<long>>>, subs array<long>, body long")
    def parsed(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        hosts, blocks, subs, bodies = [], [], [], []
        for url, page in zip(urls, pages):
            found = main_blocks(page)
            hosts.append(host_of(url))
            blocks.append([{"text": t, "subs": np.array(s, np.int64)} for t, s in found])
            subs.append(np.array(sorted({x for _, s in found for x in s}), np.int64))
            bodies.append(xxhash.xxh3_64_intdigest("\n".join(t for t, _ in found)) - (1 << 63))
        return pd.DataFrame({"host": hosts, "blocks": blocks, "subs": subs, "body": bodies})
    return parsed


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
                      many_pages: int = MANY_PAGES) -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, ``text`` (blocks joined by a
    newline) and ``n_chars``.

    Defined cases: a NULL or empty page has the text ""; a page cut off in the
    middle keeps what came before the cut; a NULL or unreadable URL is the host
    "" (all such pages are one host); repeated pages are extracted each and
    count once.
    """
    made = pages.select(R.quoted(id_col).alias("id"), R.quoted(url_col).alias("url"),
                        _parse_udf()(R.quoted(url_col), R.quoted(html_col)).alias("p"))
    # the number is given once, when the table is written
    stored = materialize(made.select(F.monotonically_increasing_id().alias("rid"), "id", "url", "p.*"))
    with_subs = F.size("subs") > 0
    seen = stored.filter(with_subs).select("rid", "host", "body", F.explode("subs").alias("h"))
    on_host = stored.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = seen.select("host", "h", "body").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(
        F.col("n") >= min_pages)
    shared = (F.col("h").bitwiseAND(F.lit(1)) == 0) & (F.col("n") >= min_share * F.col("host_pages"))
    templates = counts.join(on_host, "host").filter(shared | (F.col("n") >= many_pages)).select("host", "h")
    gone = seen.join(templates, ["host", "h"]).groupBy("rid").agg(F.collect_set("h").alias("gone"))
    plain = stored.filter(~with_subs).select("id", "url", F.col("blocks.text").alias("texts"))
    cut = stored.filter(with_subs).join(gone, "rid", "left")
    left = F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["subs"], F.col("gone")), F.lit(False)))
    done = plain.union(cut.select("id", "url", F.transform(left, lambda b: b["text"]).alias("texts")))
    text = F.array_join("texts", "\n")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"),
                       F.char_length(text).cast("long").alias("n_chars"))


def visible_text(text: str | None) -> str:
    """All text a reader sees, furniture included: blocks joined by a newline,
    without scripts, styles and the head."""
    hidden = frozenset("head script style noscript template iframe object embed svg math canvas title".split())
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        t = _squeeze(run)
        run.clear()
        if t:
            blocks.append(t)

    todo: list[tuple[object, bool]] = [(parse(text), False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            run.append(node)
        elif leaving:
            flush()
        elif node.tag == "br":
            run.append(" ")
        elif node.tag not in hidden:
            if node.tag in BLOCK:
                flush()
                todo.append((node, True))
            todo.extend((c, False) for c in reversed(node.children))
    flush()
    return "\n".join(blocks)
