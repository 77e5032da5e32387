"""Main text of web pages by consensus host paths.

Pass one parses each page, scores its containers and votes for the generalised
path (tags with their first class, digits masked) of the best ones.  Spark adds
the votes up by host.  Pass two extracts each page again, from the containers
that lie on the host's winning path; a page without one uses its own best.
Letters count for outer containers too, and the chosen containers grow to the
article around them, so nested sections, tables and quotes stay whole.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .url_filter import host_of

#: Winning paths of up to this number of hosts are broadcast (some 100 bytes each); more are joined.
BROADCAST_HOSTS = 50_000
#: Share of a letter's worth that each further container around it gets.
DECAY = 0.8
#: From this share of link letters on, a container is a list of links.
LINKED = 0.5
#: A marked element outside an article goes unless it holds this share of the page's letters, as a wrapper does.
WRAPPED = 0.5
LONGEST_PATH = 400

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea|iframe|select|title)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(?:/?[A-Za-z][^<>]*)?$", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: hidden as an attribute of its own, looked for outside quotes.
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

#: HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
SKIP = frozenset("nav footer aside form button menu dialog header object head".split())
CLOSES_P = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words of class, id and role that mark what is not the main text, wherever it stands and however long it is.
STRONG = (
    "ads? adverts? advertisements? advertorial sponsor(?:ed|s)? promo(?:tion|s)? banners? cookies? consent gdpr notices? alerts? popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menus? breadcrumbs? sidebars? footer toolbar share sharing comments? commentlist disqus replies reply pagination pager tagcloud meta byline"
).split()
#: Words that may mark a part of the article as well; inside one, such an element goes if it is mostly links.
WEAK = "side widgets? foot header masthead topbar social related recommended trending respond tags skip search copyright legal disclaimer".split()
#: Words that say nothing of their own in an id such as comment-list.
PLAIN = "user reader visitor list section area thread form box slot bar wrap wrapper container block panel top bottom left right main new latest post page site inner outer unit".split()
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_in_name = lambda words: re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words)})(?:$|[\s_-]|\d)", re.I)
MARKED, STRONGLY = _in_name(STRONG + WEAK), _in_name(STRONG)
_STRONG_WORD, _ID_WORD = (re.compile(rf"(?:{'|'.join(words)})\d*|\d+", re.I) for words in (STRONG, STRONG + PLAIN))
_ID_PARTS = re.compile(r"[\s_-]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?:$|[\s_-]|\d)", re.I)


class _Node:
    """An element: where it stands, and sums over the text inside it."""

    __slots__ = ("tag", "path", "parent", "holder", "container", "skip", "inside", "bonus", "doubt", "doubtful", "holds", "seen", "linked", "gone", "first", "last", "own", "chars", "links", "felt")

    def __init__(self, tag, path, skip, bonus, parent, doubtful=""):
        self.tag, self.path, self.skip, self.bonus, self.parent, self.doubtful = tag, path, skip, bonus, parent, doubtful
        self.container = tag in CONTAINER or parent is None
        #: The nearest container around, the element itself included; the nearest doubtful element.
        self.holder = self if self.container else parent.holder
        self.doubt = self if doubtful else parent.doubt if parent else None
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.seen = self.linked = self.own = self.chars = self.links = 0
        #: An article or main inside it, or itself one.
        self.holds = tag in ("article", "main")
        self.gone, self.first, self.last, self.felt = False, None, 0, 0.0


def _path(top: str, step: str) -> str:
    """The path of an element below another; long ones are told apart by a digest, so that deep pages stay small."""
    path = f"{top}>{step}"
    return path if len(path) <= LONGEST_PATH else "~" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def attributes_of(attributes: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}


def _strong_id(name: str) -> bool:
    """Ids are often slugs of headings: they mark strongly only if they have no words but such and plain ones."""
    words = _ID_PARTS.split(name)
    return all(map(_ID_WORD.fullmatch, words)) and any(_STRONG_WORD.fullmatch(w) and not w.isdigit() for w in words)


def hidden(attributes: str, names: dict[str, str]) -> bool:
    """Whether an element is hidden by an attribute of its own or by its style."""
    bare = "hidden" in attributes.lower() and _HIDDEN.search(_QUOTED.sub("", attributes)) is not None
    return bare or names.get("aria-hidden") == "true" or _UNSEEN.search(names.get("style", "")) is not None


def parse(page: str) -> tuple[list[_Node], list[tuple[int, str]]]:
    """(containers in order, numbered text blocks) of a page.

    A container holds the blocks from its first to its last number, the letters of
    its own paragraphs, and the felt letters, which decay outwards.  Work and
    memory grow with the page, however deep its elements are nested.
    """
    root = _Node("#", "", False, 0, None)
    stack, every, buffer, found = [root], [root], [], []
    state, open_ = {"link": 0, "linked": 0}, {}
    #: The inline element whose text is left out: its tag, how many elements were open around it, how often its tag is open.
    mute: list = []

    def flush():
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        linked, state["linked"] = state["linked"], 0
        if text and not stack[-1].skip:
            found.append((text, min(linked, len(text)), stack[-1]))

    def deal():
        """Sums of the blocks, from the innermost elements outwards; blocks of doubtful elements that are links or neither article nor wrapper are gone."""
        letters = sum(len(text) for text, _, _ in found)
        for text, linked, node in found:
            if node.doubt is not None:
                node.doubt.seen += len(text)
                node.doubt.linked += linked
        for node in reversed(every):
            if node.holds and node.parent is not None:
                node.parent.holds = True
            if node.doubtful and node.parent.doubt is not None:
                node.parent.doubt.seen += node.seen
                node.parent.doubt.linked += node.linked
        for node in every:
            apart = node.doubtful == "strong" and not node.holds and node.seen < WRAPPED * letters
            node.gone = apart or bool(node.doubtful and node.linked >= LINKED * node.seen) or bool(node.parent and node.parent.gone)
        kept = []
        for n, (text, linked, node) in enumerate(found):
            if node.gone:
                continue
            kept.append((n, text))
            holder = node.holder
            holder.own += len(text)
            holder.links += linked
            holder.first = n if holder.first is None else holder.first
            holder.last = n
        for node in reversed(every):
            if not node.container:
                continue
            node.chars += node.own
            node.felt += node.own
            if node.parent is not None and node.first is not None:
                outer = node.parent.holder
                outer.chars += node.chars
                outer.links += node.links
                outer.felt += DECAY * node.felt
                outer.first = node.first if outer.first is None else min(outer.first, node.first)
                outer.last = max(outer.last, node.last)
        return [n for n in every if n.container], kept

    def push(tag, attributes):
        top = stack[-1]
        names = attributes_of(attributes)
        first = (names.get("class", "").split() or [""])[0]
        path = _path(top.path, tag + (f".{_DIGITS.sub('#', first)}" if first else ""))
        marks = " ".join((names.get("class", ""), names.get("id", ""), names.get("role", "")))
        main = tag in ("article", "main", "body", "html")
        # a heading's own header inside an article or main is part of it
        kin = tag == "header" and top.inside
        skip, doubtful = top.skip or (tag in SKIP and not kin) or hidden(attributes, names), ""
        if not skip and not main and marks.strip() and not (top.inside and tag in HEADING):
            role, name = " ".join((names.get("class", ""), names.get("role", ""))), names.get("id", "").strip()
            if STRONGLY.search(role) or (tag not in HEADING and _strong_id(name)):
                # inside an article the mark decides; elsewhere a longer name may be a wrapper's
                skip = top.inside or any(MARKED.fullmatch(word) for word in role.split()) or MARKED.fullmatch(name) is not None
                doubtful = "" if skip else "strong"
            elif MARKED.search(role):
                skip = not top.inside and any(MARKED.fullmatch(word) for word in role.split())
                doubtful = "" if skip else "weak"
            elif tag not in HEADING and not (top.inside and tag == "section") and MARKED.search(name):
                alone = MARKED.fullmatch(name) is not None
                skip = alone and not top.inside
                doubtful = "weak" if not skip and (alone or not (top.inside or tag == "section")) else ""
        bonus = (3 if tag == "article" else 2 if tag == "main" else 0) + (1 if tag != "body" and marks.strip() and CONTENT.search(marks) else 0)
        node = _Node(tag, path, skip, bonus, top, doubtful)
        stack.append(node)
        every.append(node)
        open_[tag] = open_.get(tag, 0) + 1

    def close(i):
        if mute and i < mute[1]:
            mute.clear()
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]

    def pop(tag):
        if not open_.get(tag):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                close(i)
                return
            if tag == "p" and stack[i].tag in CONTAINER or tag != "body" and tag != "html" and stack[i].tag in ("article", "td", "body") and tag not in CONTAINER:
                return

    def inline(tag, closing, attributes):
        """Hidden and strongly marked elements inside a block are left out up to their end, or the block's."""
        if mute:
            if tag == mute[0] and not attributes.rstrip().endswith("/"):
                mute[2] += -1 if closing else 1
                if not mute[2]:
                    mute.clear()
        elif not closing and attributes and tag not in VOID and not attributes.rstrip().endswith("/"):
            names = attributes_of(attributes)
            if hidden(attributes, names) or STRONGLY.search(" ".join((names.get("class", ""), names.get("role", "")))):
                mute.extend((tag, len(stack), 1))

    def text(piece):
        if piece and not mute:
            piece = html.unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if state["link"]:
                state["linked"] += len(piece)

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            buffer.append(" ")
        elif tag == "a":
            state["link"] = 0 if m[2] else 1
            inline(tag, m[2], m[4] or "")
        elif tag in BLOCK or tag in SKIP:
            flush()
            if m[2]:
                pop(tag)
            elif tag not in VOID:
                if tag in CLOSES_P:
                    pop("p")
                if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and open_.get(tag):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "div", "article"):
                            break
                        if stack[i].tag == tag:
                            close(i)
                            break
                if not (m[4] or "").rstrip().endswith("/"):
                    push(tag, m[4] or "")
        else:
            inline(tag, m[2], m[4] or "")
    text(page[at:])
    flush()
    return deal()


def _worth(node: _Node) -> float:
    """Felt letters, less links, raised for tags and classes of main text."""
    if node.skip or not node.chars:
        return 0.0
    return node.felt * (1 - node.links / node.chars) * (1 + node.bonus)


def best_paths(page: str | None) -> list[tuple[str, float]]:
    """Generalised paths of the page's containers with their share of the page's worth."""
    if not page:
        return []
    found: dict[str, float] = {}
    for node in parse(page)[0]:
        if (worth := _worth(node)) > 0:
            found[node.path] = found.get(node.path, 0.0) + worth
    whole = sum(found.values())
    return [(path, worth / whole) for path, worth in found.items()] if whole else []


def _whole(node: _Node) -> _Node:
    """The container that holds all of the text that node is a part of.

    An article or main around it is; so is a container with paragraphs of its own,
    and what is around a cell, quote or section.  A body is one only with
    paragraphs of its own around cells, quotes and sections: its other divs may
    be anything.  Lists of links are not entered.
    """
    best, inner, outer = node, node, node.parent
    while outer is not None:
        if outer.tag in CONTAINER or outer.parent is None:
            part = inner.tag in ("td", "blockquote", "section")
            if outer.tag in ("article", "main"):
                grows = outer.own > 0 or best.tag not in ("article", "main")
            elif outer.tag in ("body", "#"):
                grows = best is inner and outer.own > 0 and part
            else:
                grows = best is inner and (outer.own > 0 or part)
            if grows and outer.links < LINKED * outer.chars:
                best = outer
            inner = outer
        outer = outer.parent
    return best


def extract(page: str | None, path: str | None) -> str:
    """Blocks of the containers on the path, else of the page's best path, with the text around them that belongs to them, joined by blank lines."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    nodes = [n for n in nodes if not n.skip and n.first is not None]
    if not nodes:
        return ""
    chosen = [n for n in nodes if n.path == path]
    if not chosen:
        worth: dict[str, float] = {}
        for n in nodes:
            worth[n.path] = worth.get(n.path, 0.0) + _worth(n)
        top = min(worth, key=lambda p: (-round(worth[p], 6), p))  # ties as in the votes
        chosen = [n for n in nodes if n.path == top]
    spans = sorted({(w.first, w.last) for w in map(_whole, chosen)})
    out, at = [], 0
    for n, text in blocks:
        while at < len(spans) and spans[at][1] < n:
            at += 1
        if at < len(spans) and spans[at][0] <= n:
            out.append(text)
    return "\n\n".join(out)


def _vote_rows(batches):
    for batch in batches:
        hosts, paths, worths = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for path, worth in best_paths(page.as_py()):
                hosts.append(host)
                paths.append(path)
                worths.append(worth)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(worths, pa.float64())], ["host", "path", "worth"])


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the most votes of each host; ties go to the first path in order."""
    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).where("html is not null").mapInArrow(_vote_rows, "host string, path string, worth double")
    summed = votes.groupBy("host", "path").agg(F.sum(F.round("worth", 6).cast("decimal(28,6)")).alias("worth"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("worth"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars.

    White space inside a block becomes one space; blocks are joined by two line
    feeds in page order.  Null or empty html gives an empty text.  Pages without
    a host (null urls too) vote together.  Unclosed and cut off markup is read as
    browsers would, as far as block order goes; a tag that the page's end cuts
    off is dropped.  Menus, notices, adverts, comments and the like go by their
    tag, class, role or id, and hidden text by its attribute or style, inside an
    article, also inside a sentence, and however long.  A name that only holds
    such a word may be a wrapper's: outside an article its element stays if an
    article is in it or WRAPPED of the page's letters.
    """
    ws = Workspace(pages.sparkSession)
    winners = ws.save(winning_paths(pages, url_col, html_col).withColumnRenamed("host", "_host"), "winners")
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))
    rows = rows.withColumn("_host", host_of(F.col("_url").cast("string"))).join(winners, "_host", "left").select("_id", "_url", "_html", "path")

    def run(batches):
        for batch in batches:
            texts = [extract(page.as_py(), path) for page, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])

    out = rows.mapInArrow(run, f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
