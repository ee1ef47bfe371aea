"""HTML extraction by tag-path ratios.

A page is read once into elements, each with its parent, and text blocks in page order. A block's tag path is the tags from the root to
the element it stands in. Per path, text length, punctuation and blocks are added up; its ratio is the text per block, raised by the
punctuation per block. The ratios, laid out in page order, are smoothed by a binomial kernel over five blocks; a path's smoothed mean is
fused with its own ratio by the geometric mean. Paths of at least ``share`` of the fused ratios' mean, weighted by text, are content.

Elements that by tag, role, class or id are menus, headers, footers, sidebars, notices, adverts, forms, hidden or comments are marked, and
a marked step is part of the path, so what is inside has paths of its own; their fused ratio counts a twentieth (nothing for menus, page
footers and form controls). A class or id marks only as a whole: all its words must be such names or plain additions ("site-footer", not
"has-sidebar" or "notice-board"). A mark doesn't count on an element around most of the text that is content without marks: it holds the page.

The content nodes are the selected paths' blocks. What an article is made of is kept whole: of articles (or the main element) that hold a
good part of the selected text all unmarked blocks; without such, of the deepest element around nearly all selected text the blocks from its
first heading or selected block to its last selected one.

Block text: character references decoded, white space runs one space, trimmed; blocks in page order joined by a newline. A <br> is
white space. Open <p>, <li>, <td> and the like end where HTML ends them; a stray end tag is ignored. Time and memory are in proportion to
the page, whatever its nesting or broken tags: paths are numbers, open elements are looked up by tag, and no part is scanned twice.

Defined cases: a null html counts as empty; pages without content give the empty string. A tag without its ">" is no text. Repeated rows
are rows of their own. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import P

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER_TAGS = frozenset("nav footer menu button label select datalist".split())
MARKED_TAGS = frozenset("header aside form dialog".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu masthead
    header footer sidebar aside breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe
    subscription signup social share sharing related recommended recommendations comment comments disqus reply replies respond
    widget widgets toolbar pagination pager copyright legal disclaimer login search side sidenav topnav topbar navlinks navmenu adbox adslot adunit
    cookiebar cookiebanner notification notifications toc commentlist trending popular""".split()
)
#: Words that leave such a name what it is.
ADDITIONS = frozenset("site page main top bottom left right primary secondary global mobile desktop box bar list section area wrap wrapper container inner outer block panel form links item items post posts articles story stories buttons icons text the my wp js".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_TAGS = frozenset("article main".split())
#: What an open element ends when it starts: (these, not beyond those).
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
P_ENDS = (("p",), ("button", "table", "td", "th", "li", "div", "article", "section"))
THROUGH_TABLES = frozenset("table html body article main div".split())

_OPEN = re.compile(r"<(?:(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)|(?P<mark>!--|!\[CDATA\[|[!?/]))")
# attributes up to the tag's end; a quote counts after an equals sign
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'\s])))*+>""")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?![^\s=>/])\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}

MARK, NEVER, COMMENTS, CONTENT = 1, 2, 4, 8  # what is known of an element


def _named(token: str) -> int:
    """What one class or id says."""
    words = [w.lower() for w in _WORDS.findall(token) if not w.isdigit()]
    found = [w for w in words if w in NAMES]
    if not found or not all(w in NAMES or w in ADDITIONS for w in words):
        return 0
    return MARK | (COMMENTS if COMMENT_NAMES.intersection(found) else 0)


def _attributes(attrs: str) -> int:
    known = 0
    for name, *values in _ATTR.findall(attrs):
        value, name = next((v for v in values if v), ""), name.lower()
        if name in ("class", "id"):
            for token in value.split():
                known |= _named(token)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _NONE.search(value):
            known |= MARK
        elif name == "role":
            known |= MARK if value.lower() in MARKED_ROLES else CONTENT if value.lower() in ("main", "article") else 0
        elif name == "itemprop":
            known |= CONTENT if value == "articleBody" else MARK | COMMENTS if value == "comment" else 0
    return known


class Page:
    """Elements (0 is the root): parent, tag, known. Blocks: (element, pieces); a piece is (innermost element, text)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.known = [0], [""], [0]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self._stack = [0]  # open elements
        self._levels: dict[str, list[int]] = {}  # levels of the open elements of each tag
        self._block_levels = [0]
        self._pending: list[tuple[int, str]] = []
        self._read(source)

    def _level(self, *tags: str) -> int:
        return max((found[-1] for t in tags if (found := self._levels.get(t))), default=0)

    def _flush(self) -> None:
        if self._pending:
            if any(not text.isspace() for _, text in self._pending):
                self.blocks.append((self._stack[self._block_levels[-1]], self._pending))
            self._pending = []

    def _pop(self, level: int) -> None:
        while len(self._stack) > level:
            tag = self.tag[self._stack.pop()]
            self._levels[tag].pop()
            if self._block_levels[-1] >= len(self._stack):
                self._block_levels.pop()

    def _text(self, text: str) -> None:
        if text:
            self._pending.append((self._stack[-1], _html.unescape(text) if "&" in text else text))

    def _read(self, source: str) -> None:
        at, last, lenient = 0, source.rfind(">"), False
        while m := _OPEN.search(source, at):
            self._text(source[at : m.start()])
            if mark := m["mark"]:
                end = "-->" if mark == "!--" else "]]>" if mark == "![CDATA[" else ">"
                if end == "-->" and source.startswith(("<!-->", "<!--->"), m.start()):
                    end = ">"
                stop = source.find(end, m.end())
                if stop < 0 and end != ">":  # never closed: ends at its first ">"
                    end, stop = ">", source.find(">", m.end())
                if stop < 0:
                    at = len(source)
                    break
                at = stop + len(end)
                continue
            if m.end() > last:  # no tag ends any more
                at = len(source)
                break
            rest = None if lenient else _REST.match(source, m.end())
            lenient |= rest is None
            at = rest.end() if rest else source.find(">", m.end()) + 1
            tag, attrs = m["tag"].lower(), source[m.end() : at - 1]
            if m["close"]:
                self._close(tag)
            elif tag == "br":
                self._pending.append((self._stack[-1], " "))
            elif tag in RAW:
                if not (tag == "svg" and attrs.endswith("/")):
                    end = _RAW_END[tag].search(source, at)
                    at = end.end() if end else len(source)
            else:
                self._open(tag, attrs)
        self._text(source[at:])
        self._flush()

    def _close(self, tag: str) -> None:
        level = self._level(tag)
        if tag in BLOCK:
            if level and (tag in THROUGH_TABLES or level > self._level("table")):
                self._flush()
                self._pop(level)
            elif tag == "p":
                self._flush()
        elif level > self._block_levels[-1]:  # an inline end doesn't end blocks
            self._pop(level)

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
            for these, those in (*([ENDS[tag]] if tag in ENDS else []), P_ENDS):
                level = self._level(*these)
                if level > self._level(*those):
                    self._pop(level)
                    break
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            return
        known = _attributes(attrs) if attrs else 0
        if tag in CONTENT_TAGS:
            known |= CONTENT
        elif tag in NEVER_TAGS and not (tag == "footer" and self._levels.get("blockquote")):
            known |= MARK | NEVER
        elif tag in MARKED_TAGS and not (tag == "header" and any(self._levels.get(t) for t in CONTENT_TAGS)):
            known |= MARK  # the head of an article is part of it
        if tag in ("html", "body"):
            known = 0
        e = len(self.parent)
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.known.append(known)
        self._levels.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCK:
            self._block_levels.append(len(self._stack))
        self._stack.append(e)

    def paths(self, marked: list[bool]) -> list[int]:
        """Each element's tag path as a number, marks being part of it; inline elements have that of their block."""
        numbers: dict[tuple[int, str, bool], int] = {}
        out = [0] * len(self.parent)
        for e in range(1, len(out)):
            above = out[self.parent[e]]
            plain = self.tag[e] not in BLOCK and not marked[e]
            out[e] = above if plain else numbers.setdefault((above, self.tag[e], marked[e]), len(numbers) + 1)
        return out

    def sums(self, own: list[int]) -> list[int]:
        """Of each element the values of it and all below it added up."""
        out = own[:]
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def path_scores(blocks: list[tuple[int, str]]) -> dict[int, float]:
    """The fused ratio of each path; ``blocks``: (path, text) in page order."""
    length: dict[int, int] = {}
    punctuation: dict[int, int] = {}
    count: dict[int, int] = {}
    for path, text in blocks:
        length[path] = length.get(path, 0) + len(text)
        punctuation[path] = punctuation.get(path, 0) + len(_PUNCT.findall(text))
        count[path] = count.get(path, 0) + 1
    ratio = {p: length[p] / count[p] * (1 + punctuation[p] / count[p]) ** 0.5 for p in length}
    line = [ratio[p] for p, _ in blocks]
    ends = [line[0]] * 2 + line + [line[-1]] * 2
    smooth: dict[int, float] = {}
    for i, (p, _) in enumerate(blocks):
        a, b, c, d, e = ends[i : i + 5]
        smooth[p] = smooth.get(p, 0) + (a + 4 * b + 6 * c + 4 * d + e) / 16
    return {p: (ratio[p] * smooth[p] / count[p]) ** 0.5 for p in ratio}


def selected_paths(blocks: list[tuple[int, str]], share: float, weight: dict[int, float]) -> set[int]:
    """The paths whose fused ratio is above the threshold; with a ``weight`` (1 where not given) the weighted ratio must be, and above that of all paths."""
    fused = path_scores(blocks)

    def limit(of: list[tuple[int, str]]) -> float:
        return share * sum(fused[p] * len(t) for p, t in of) / sum(len(t) for _, t in of) * (1 - 1e-9)

    plain = [(p, t) for p, t in blocks if p not in weight]
    if not plain:
        return set()
    own, whole = limit(plain), limit(blocks)
    return {p for p in fused if (fused[p] >= own if p not in weight else fused[p] * weight[p] >= max(own, whole))}


def _text(pieces: list[tuple[int, str]], gone: list[bool] | None = None) -> str:
    return " ".join("".join(t for e, t in pieces if gone is None or not gone[e]).split())


def _holders(page: Page, texts: list[str], share: float) -> set[int]:
    """Marked elements around most of the text that is selected without regard to marks: they hold the content.

    Where an article stands beside one, or it is named after comments, it must also hold a main heading.
    """
    marked = [e for e, k in enumerate(page.known) if k & MARK and not k & NEVER]
    if not marked:
        return set()
    paths = page.paths([False] * len(page.parent))
    in_path = [(paths[e], t) for (e, _), t in zip(page.blocks, texts)]
    chosen = selected_paths(in_path, share, {})
    size, heads, inside = ([0] * len(page.parent) for _ in range(3))
    content = [False] * len(page.parent)
    for e in range(1, len(content)):
        content[e] = content[page.parent[e]] or bool(page.known[e] & CONTENT)
    for (e, _), (p, t) in zip(page.blocks, in_path):
        size[e] += len(t) * (p in chosen)
        heads[e] += page.tag[e] == "h1"
        inside[e] += content[e]
    size, heads, inside = page.sums(size), page.sums(heads), page.sums(inside)

    def holds(e: int) -> bool:
        whole = inside[e] == inside[0] and (not page.known[e] & COMMENTS or size[e] == size[0])
        return 2 * size[e] > size[0] and bool(heads[e] or whole)

    return {e for e in marked if holds(e)}


def extract(source: str, share: float = 0.35, covering: float = 0.9, marked_weight: float = 0.05) -> str:
    page = Page(source)
    texts = [_text(pieces) for _, pieces in page.blocks]
    if not texts:
        return ""
    holders = _holders(page, texts, share)
    n = len(page.parent)
    marked = [bool(k & MARK) and e not in holders for e, k in enumerate(page.known)]
    under = marked[:]  # marked, or inside of one
    never = [bool(k & NEVER) for k in page.known]
    for e in range(1, n):
        under[e] |= under[page.parent[e]]
        never[e] |= never[page.parent[e]]
    paths = page.paths(marked)
    blocks: list[tuple[int, str]] = []  # (element, text), of a block's pieces only those as marked as it is
    for (e, pieces), text in zip(page.blocks, texts):
        if not under[e] and any(under[x] for x, _ in pieces):
            text = _text(pieces, under)
        if text:
            blocks.append((e, text))
    weight = {paths[e]: 0.0 if never[e] else marked_weight for e, _ in blocks if under[e]}
    chosen = selected_paths([(paths[e], t) for e, t in blocks], share, weight) if blocks else set()
    seeds = [i for i, (e, _) in enumerate(blocks) if paths[e] in chosen]
    if not seeds:
        return ""
    kept = _articles(page, blocks, seeds, under, covering) or _around(page, blocks, seeds, under, covering)
    return "\n".join(blocks[i][1] for i in sorted({*kept, *(i for i in seeds if under[blocks[i][0]])}))


def _articles(page: Page, blocks: list, seeds: list[int], under: list[bool], covering: float) -> list[int]:
    """The unmarked blocks of the articles, or of all content elements where those hold more; none if they hold less than a third of the selected text."""
    whole = sum(len(blocks[i][1]) for i in seeds)
    best: list[int] = []
    size = 0
    for only_articles in (True, False):
        inside = [False] * len(page.parent)
        for e in range(1, len(inside)):
            inside[e] = inside[page.parent[e]] or bool(page.known[e] & CONTENT) and not (only_articles and page.tag[e] == "main")
        own = sum(len(blocks[i][1]) for i in seeds if inside[blocks[i][0]])
        if own * covering > size:
            best, size = [i for i, (e, _) in enumerate(blocks) if inside[e] and not under[e]], own
    return best if 3 * size >= whole else []


def _around(page: Page, blocks: list, seeds: list[int], under: list[bool], covering: float) -> list[int]:
    """Of the deepest element around nearly all selected text: headings before the first selected block, and all unmarked blocks up to the last."""
    own = [0] * len(page.parent)
    for i in seeds:
        own[blocks[i][0]] += len(blocks[i][1])
    size = page.sums(own)
    root = max(e for e in range(len(size)) if size[e] >= covering * size[0])  # of elements inside one another the last is the deepest
    inside = [False] * len(page.parent)
    inside[root] = True
    for e in range(root + 1, len(inside)):
        inside[e] = inside[page.parent[e]]
    there = [i for i, (e, _) in enumerate(blocks) if inside[e] and not under[e]]
    heads = [i for i in there if page.tag[blocks[i][0]] in HEADINGS and i < seeds[0]]
    title = [i for i in range(seeds[0]) if page.tag[blocks[i][0]] == "h1" and not under[blocks[i][0]]][-1:]
    first = heads[0] if heads else seeds[0]
    return sorted({*title, *(i for i in there if first <= i <= seeds[-1]), *(i for i in seeds if inside[blocks[i][0]])})


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *others: str) -> DataFrame:
    """(id, *others, text, n_chars) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [extract(x or "") for x in batch.column(P + "h").to_pylist()]
            keep = [batch.column(c) for c in (id_col, *others)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, *others, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, *others))
    return pages.select(id_col, *others, F.col(html_col).alias(P + "h")).mapInArrow(run, f"{kinds}, text string, n_chars bigint")
