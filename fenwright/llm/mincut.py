"""HTML main-text extraction as a minimum cut.

A page becomes a row of text blocks. A classifier turns what is known of a
block (length, sentences, link share, its ancestors' tags, class and role names,
whether the page names a main part and where that is, whether it follows a heading
of reader comments) into graded costs of calling it content or boilerplate; these
are the capacities of its edges to the two terminals. Neighbouring blocks, and blocks
under one parent, are tied by smoothness edges of a like size, so a block whose own
evidence is weak goes with those around it. The maximum flow's cut gives the
labelling of least total cost; blocks on the source side are the main text.

Defined cases: a null or empty page, and a page without content blocks, give an
empty text; broken markup is read on as browsers do (unclosed elements end
with their parents); hidden elements, scripts, styles and comments have no blocks;
null page_ids and urls stay null; repeated rows are read each; columns besides
page_id, url and html are ignored; an empty table gives no rows. The work is per
row, without a shuffle; time and memory follow the length of a page, broken or not.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements and what pages call their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes noembed xmp".split())
HIDDEN = frozenset("head template svg math object canvas audio video".split())
#: Elements in which "/>" ends an element, those in them that hold HTML again, and HTML elements that end them.
FOREIGN = frozenset(["svg", "math"])
HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike "
    "sub sup table tt u ul var".split()
)
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
SELF_CLOSING = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: A new one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("html body table td th ul ol dl div section article aside main nav header footer form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = frozenset("nav footer aside form button select menu dialog fieldset input".split())
GOOD_TAGS = frozenset("article main".split())
BAD_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar form toolbar".split())
BAD_NAMES = frozenset(
    "nav navbar navigation menu sidebar footer header masthead topbar bottombar ad ads advert adverts advertisement adsbygoogle banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice alert comment comments commentlist reply replies discussion disqus share sharing social related "
    "recommended recommendations breadcrumb breadcrumbs pagination pager subscribe subscription newsletter signup login popup modal overlay widget toolbar "
    "copyright legal disclaimer search form tags trending popular skip".split()
)
GOOD_NAMES = frozenset("article content post entry story main body text maintext bodytext articlebody postbody".split())
COMMENT_NAMES = frozenset("comment comments commentlist reply replies responses discussion disqus respond".split())
#: Headings of reader comments.
COMMENT_HEADING = re.compile(
    r"\d+ (comments?|responses?|replies|reply|thoughts|reactions)( (on|to)\b.*)?|(reader |user )?(comments|responses|replies)( \(\d+\))?:?|leave a (reply|comment)|join the (discussion|conversation)|no (comments|responses) yet", re.I
)

# Weights of the classifier, in units of one smoothness edge. A part's own weight is that of its strongest mark.
BAD_TAG, BAD_NAME, COMMENTS, GOOD_PART, OUTSIDE = 14, 8, 16, 6, 10
MOST_GOOD_LENGTH, MOST_SENTENCES = 5, 3
ADJACENT, SIBLING, SAME_PARENT = 1, 1, 2

_SPECIAL = re.compile("[>\"']")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=\"'/>]+)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?。…]")


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\t\r\n") else {}


class _Node:
    __slots__ = ("tag", "parent", "depth", "bad", "good", "hidden", "link", "foreign", "talk")

    def __init__(self, tag: str, parent: _Node | None, attrs: dict[str, str]):
        self.tag, self.parent = tag, parent
        self.talk = bool(parent and parent.talk)
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = bool(parent and parent.hidden) or tag in HIDDEN or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
        self.foreign = tag in FOREIGN or bool(parent and parent.foreign and tag not in HTML_AGAIN)
        self.link = tag == "a" or bool(parent and parent.link)
        names = {x.lower() for x in _NAME.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")} if attrs else frozenset()
        bad, good = bool(names & BAD_NAMES), bool(names & GOOD_NAMES)
        talk = bool(names & COMMENT_NAMES)
        role = attrs.get("role", "").lower()
        if tag in ("html", "body"):
            bad = good = talk = False
        elif tag in GOOD_TAGS:
            bad, good = talk, not talk
        elif bad and good and not talk:  # a wrapper that names what it holds
            bad = good = False
        if role in ("main", "article"):
            bad, good = talk, not talk
        in_good = bool(parent and parent.good)
        if talk:
            mark = COMMENTS
        elif tag in BAD_TAGS or role in BAD_ROLES or tag == "header" and not in_good:
            mark = BAD_TAG
        elif bad and not (tag in HEADINGS and in_good):
            mark = BAD_NAME
        else:
            mark = 0
        #: Weight of the strongest mark of boilerplate on the way down; `good`: inside what the page calls its main part.
        self.bad = max(mark, parent.bad if parent else 0)
        self.good = (good or in_good) and self.bad < BAD_TAG


class Block:
    """talk: whether it follows a heading of reader comments in the same part."""

    __slots__ = ("text", "node", "linked", "talk")

    def __init__(self, text: str, node: _Node, linked: int):
        self.text, self.node, self.linked, self.talk = text, node, linked, node.talk


class _Tags:
    """Tags of a page from left to right, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.loose, self.no_comment_end = page, False, False

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """Start, end, slash, name and attributes of the next tag from `at` on; a comment or declaration has no name.

        A tag or declaration that the page ends in reaches to its end, as browsers have it.
        """
        page = self.page
        last = len(page)
        while True:
            a = page.find("<", at)
            if a < 0 or a + 1 >= last:
                return last, last, "", "", ""
            c = page[a + 1]
            if c in "!?":
                end = self._comment(a) if page.startswith("<!--", a) else -1
                if end < 0:
                    end = page.find(">", a) + 1
                return a, end or last, "", "", ""
            slash = "/" if c == "/" else ""
            m = _TAG_NAME.match(page, a + 1 + len(slash))
            if m:
                end = self._close(m.end())
                return (a, end + 1, slash, m[0].lower(), page[m.end() : end]) if end >= 0 else (a, last, "", "", "")
            at = a + 1

    def _comment(self, a: int) -> int:
        if self.page.startswith(("<!-->", "<!--->"), a):
            return self.page.index(">", a) + 1
        end = -1 if self.no_comment_end else self.page.find("-->", a + 4)
        self.no_comment_end = end < 0
        return end + 3 if end >= 0 else -1

    def _close(self, at: int) -> int:
        """The > that ends a tag; quotes that do not pair up to the end of the page count as plain from then on."""
        first, page = at, self.page
        while not self.loose:
            m = _SPECIAL.search(page, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            at = page.find(m[0], m.end()) + 1
            if not at:
                break
        self.loose = True
        return page.find(">", first)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Inline elements do not end a block, all others do."""
    out: list[Block] = []
    node, parts, linked, at, end = _Node("html", None, {}), [], 0, 0, len(page)
    tags, open_ = _Tags(page), Counter()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                home = node
                while home.parent and home.tag in INLINE:
                    home = home.parent
                if home.tag in HEADINGS and len(text) < 60 and home.parent.tag not in ("html", "body", *GOOD_TAGS) and COMMENT_HEADING.fullmatch(text):
                    home.talk = home.parent.talk = True
                out.append(Block(text, home, linked))
            parts.clear()
        linked = 0

    def go_to(x: _Node) -> None:
        nonlocal node
        while node is not x:
            open_[node.tag] -= 1
            node = node.parent

    def text(a: int, b: int) -> None:
        nonlocal linked
        if node.tag == "head" and page[a:b].strip():
            go_to(node.parent)
        if b > a and not node.hidden:
            parts.append(page[a:b])
            if node.link:
                linked += len(page[a:b].strip())

    while at < end:
        start, stop_, slash, tag, attrs = tags.next(at)
        text(at, start)
        at = stop_
        if not tag:
            continue
        if slash:
            if open_[tag]:
                x = node
                while x.tag != tag:
                    x = x.parent
                if tag not in INLINE:
                    flush()
                go_to(x.parent)
            continue
        if node.tag == "head" and tag not in IN_HEAD:
            go_to(node.parent)
        if node.foreign and tag in ENDS_FOREIGN:
            while node.foreign:
                go_to(node.parent)
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if (node.foreign or tag in FOREIGN) and attrs.endswith("/"):
            continue
        if tag in RAW and not node.foreign:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", close.end()) if close else -1
            at = stop + 1 if stop >= 0 else end
            if tag in INLINE:
                parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag == "body":
            while node.parent:
                go_to(node.parent)
        ends = SELF_CLOSING.get(tag, frozenset()) | (frozenset(["p"]) if tag in ENDS_P else frozenset())
        if any(open_[e] for e in ends):
            x = node
            while x.parent and x.tag not in ends and (x.tag not in SCOPES):
                x = x.parent
            if x.tag in ends and x.parent:
                go_to(x.parent)
        if attrs.endswith("/") and tag in ("path", "g", "use"):
            continue
        node = _Node(tag, node, _attributes(attrs))
        open_[tag] += 1
    flush()
    return out


def costs(bs: list[Block]) -> list[tuple[int, int]]:
    """Terminal capacities of each block: what it costs to call it boilerplate, and content."""
    main = any(b.node.good for b in bs)
    out = []
    for b in bs:
        n, node = len(b.text), b.node
        share = b.linked / n
        good = min(MOST_GOOD_LENGTH, n // 60) + min(MOST_SENTENCES, len(_SENTENCE.findall(b.text, 0, 4000)))
        good += GOOD_PART * node.good + (node.tag in HEADINGS) + (node.tag in ("p", "blockquote", "pre", "td", "dd"))
        bad = max(node.bad, COMMENTS * b.talk)
        bad += OUTSIDE * (main and not node.good)
        bad += 5 if share > 0.5 else 2 if share > 0.25 else 0
        bad += n < 25
        bad += 3 * ("\N{COPYRIGHT SIGN}" in b.text and n < 300)
        out.append((good, bad))
    return out


def edges(bs: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges between blocks in page order, and between blocks of the same parent's parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i:
            a = bs[i - 1]
            same = a.node is b.node or (a.node.parent is b.node.parent and a.node.parent is not None)
            out.append((i - 1, i, ADJACENT + (SAME_PARENT if same else 0)))
        home = id(b.node.parent or b.node)
        j = last.get(home)
        if j is not None and j < i - 1:
            out.append((j, i, SIBLING))
        last[home] = i
    return out


def min_cut(terminals: list[tuple[int, int]], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut.

    What both terminals of a node share flows straight through it; the rest is
    found by shortest augmenting paths over level graphs.
    """
    n = len(terminals)
    left = [s - t for s, t in terminals]  # > 0: room from the source, < 0: room to the sink
    to: list[int] = []
    room: list[int] = []
    of: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in ties:
        of[a].append(len(to))
        of[b].append(len(to) + 1)
        to += [b, a]
        room += [c, c]
    while True:
        level = [0 if x > 0 else -1 for x in left]
        queue = deque(i for i, x in enumerate(left) if x > 0)
        reached = False
        while queue:
            a = queue.popleft()
            for e in of[a]:
                b = to[e]
                if room[e] > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    reached |= left[b] < 0
                    queue.append(b)
        if not reached:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for s in [i for i, x in enumerate(left) if x > 0]:
            path: list[int] = []
            a = s
            while left[s] > 0:
                if left[a] < 0 and path:
                    flow = min(left[s], -left[a], *(room[e] for e in path))
                    left[s] -= flow
                    left[a] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, a = [], s
                    continue
                while nxt[a] < len(of[a]):
                    e = of[a][nxt[a]]
                    if room[e] > 0 and level[to[e]] == level[a] + 1:
                        break
                    nxt[a] += 1
                if nxt[a] < len(of[a]):
                    path.append(of[a][nxt[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break


def extract(page: str | None) -> str:
    bs = blocks(page or "")
    keep = min_cut(costs(bs), edges(bs))
    return " ".join(b.text for b, k in zip(bs, keep, strict=True) if k)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [extract(x) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=_OUT
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
