"""Main-text extraction from HTML by tag-path ratios.

The text of a page lies in blocks; blocks are grouped by the tag path (with class names) from the root to their element.
Per path, the characters and the punctuation per block are fused, with the path's share of the page's text. The sequence of
these ratios in page order is smoothed with its neighbours by geometric means, so that no short block gains much from long
ones beside it (and none from those in another part of the page), and averaged over each path. Paths over a share of the best one are content. What tags and names say only
weighs near ties, but for menus, headers, footers, forms, notices and reader comments, which never are candidates.

The lowest element around all content blocks, with headings and paragraphs that stand beside it, is the article (the
article element around it, if there is one). Inside it, text goes whose path is no content if it stands in a part of its
own that holds no content: another article element, an element named like an advert, a link list outside an article element,
or a div or section of any name whose paths all are faint. Headings, short paragraphs, lists and tables of the article stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup, or shows no text of the page.
RAW = frozenset("script style textarea title noscript iframe template noembed noframes svg canvas audio video select".split())
#: Elements that stand for boilerplate; a header does outside an article.
ASIDE = frozenset("head nav footer aside form menu".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks of running text: a link that is all of one is no menu.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption pre caption dt dd".split())
#: Beside the content, these belong to it.
BESIDE = frozenset("p h1 h2 h3 blockquote figure figcaption pre hgroup".split())
#: Starting one of these ends an open p.
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Ends of other tags than blocks do not reach out of these.
SCOPES = frozenset("article main body td th".split())
P_BOUND, SCOPE = "#p", "#scope"
#: Starting the key ends an open element of the values, up to the nearest of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: Words of a class, id or role that name menus, footers, notices and comments: never candidates.
NAMES = frozenset(
    "menu navbar nav navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice gdpr popup modal newsletter subscribe "
    "subscription signup login comment comments disqus reply replies respond pagination pager toolbar copyright disclaimer".split()
)
#: Words that make an advert or an extra likely; the ratio of its path decides.
LIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion side rail share sharing social related recommended "
    "recommendations widget teaser werbung anzeige anzeigen reklame publicidad anuncio anuncios publicité publicite annonce pubblicità pubblicita "
    "publicidade reclame advertentie reklama реклама 広告 广告 廣告 광고".split()
)
#: Words behind a name that say nothing of their own.
SHAPES = frozenset("area bar block bottom box button buttons container group inner item items left link links list right section slot top unit wrap wrapper".split())
#: Parts that can be something of their own inside an article.
PARTS = frozenset("article center details div section".split())
#: Before a name, these say that an element has it, not that it is it.
ABOUT = frozenset("has no with without show hide is not".split())

#: A path is content from this share of the best path's score on, and faint below that one.
LEAST, FAINT = 0.1, 0.01
#: What an article, a main element, and a likely extra weigh; what is no candidate at all.
ARTICLE, MAIN, EXTRA, NEVER = 3.0, 2.0, 0.5, 0.0
#: A character of a link counts as this much text.
LINKED = 0.125
#: In a page of so many characters of text, a prior counts twice; in one of much more, once.
SPARSE = 200

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>=]")
QUOTE = re.compile(r"\s*([\"']?)")
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|open)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT_NAME = re.compile(r"[\W_]+|(?<=[^\W\d_])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
DIGITS = re.compile(r"[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、！？؟،]")
ENDS_RAW = {t: re.compile(f"</{t}", re.I) for t in RAW}


def _head(word: str) -> str:
    """The word that a compound name is about: its last one, behind which stand only numbers and words for shapes."""
    parts = [x for x in SPLIT_NAME.split(CAMEL.sub("-", word).lower()) if x and not x.isdigit()]
    if not ABOUT.isdisjoint(parts):
        return ""
    while len(parts) > 1 and parts[-1] in SHAPES:
        parts.pop()
    return parts[-1] if parts else ""


def attributes(attrs: str) -> tuple[bool, float, bool, str]:
    """Whether an element is hidden, what its names weigh, whether it is open, and its names without digits."""
    hidden, weight, opened, names = False, 1.0, False, []
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "open":
            opened = True
        elif name == "hidden":
            hidden = True
        elif name in ("aria-hidden", "style"):
            hidden |= value == "true" if name == "aria-hidden" else bool(HIDDEN.search(value))
        else:
            for word in value.split():
                head = _head(word)
                weight = min(weight, NEVER if head in NAMES else EXTRA if head in LIKELY else 1.0)
                names.append(DIGITS.sub("", word))
    return hidden, weight, opened, " ".join(sorted(names))


class Page:
    """Elements (a parent comes before its children) and text nodes (element, text, block, whether in a link). Unclosed
    elements end as browsers end them: p at the next block, li, td and the like at the next of their kind. One pass,
    linear in the page: searches for what is not there are not repeated."""

    def __init__(self, html: str):
        self.tag, self.parent, self.weight, self.names, self.gone = [""], [-1], [1.0], [""], [False]
        self.nodes: list[tuple[int, str, int, bool]] = []
        self._read(html)

    def _end(self, html: str, at: int, missing: set[str]) -> int:
        """Behind the tag that starts before `at`; quotes open only after an equals sign."""
        while m := STOP.search(html, at):
            if m.group() == ">":
                return m.end()
            q = QUOTE.match(html, m.end())
            at, quote = q.end(), q.group(1)
            if quote and quote not in missing:
                close = html.find(quote, at)
                if close < 0:
                    missing.add(quote)
                else:
                    at = close + 1
        return len(html)

    def _read(self, html: str) -> None:
        tags, parents, nodes = self.tag, self.parent, self.nodes
        stack, missing = [0], set()
        places: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag and group
        at, n, block = 0, len(html), 0

        def open_at(names: Iterable[str]) -> int:
            return max((places[k][-1] for k in names if places.get(k)), default=-1)

        def groups(tag: str) -> list[str]:
            return [tag] + [P_BOUND] * (tag in ENDS_P) + [SCOPE] * (tag in SCOPES)

        def close(i: int) -> None:
            for e in stack[i:]:
                for k in groups(tags[e]):
                    places[k].pop()
            del stack[i:]

        def end(kinds: Iterable[str], bounds: Iterable[str]) -> None:
            i = open_at(kinds)
            if i > 0 and i >= open_at(bounds):
                close(i)

        while at < n:
            lt = html.find("<", at)
            if lt != at:
                nodes.append((stack[-1], html[at : lt if lt >= 0 else n], block, bool(places.get("a"))))
                at = lt if lt >= 0 else n
                continue
            m = TAG.match(html, at)
            if m is None:
                if html.startswith("<!--", at):
                    to = html.find("-->", at + 4)
                    at = n if to < 0 else to + 3
                elif html.startswith(("<!", "<?", "</"), at):
                    to = html.find(">", at)
                    at = n if to < 0 else to + 1
                else:
                    nodes.append((stack[-1], "<", block, bool(places.get("a"))))
                    at += 1
                continue
            tag, start = m.group(2).lower(), m.end()
            at = self._end(html, start, missing)
            if tag in BLOCKS:
                block += 1
            if m.group(1):
                end((tag,), () if tag in BLOCKS else (SCOPE,))
                continue
            if tag in ENDS_P:
                end(("p",), (P_BOUND,))
            if tag in ENDS:
                end(*ENDS[tag])
            if tag in VOID:
                if tag in ("br", "hr"):
                    nodes.append((stack[-1], " ", block, bool(places.get("a"))))
                continue
            attrs = html[start:at]
            if tag in RAW:
                if not attrs.endswith("/>") and tag not in missing:
                    found = ENDS_RAW[tag].search(html, at)
                    to = html.find(">", found.end()) if found else -1
                    at = n if to < 0 else to + 1
                continue
            hidden, weight, is_open, names = attributes(attrs) if len(attrs) > 1 else (False, 1.0, False, "")
            up = stack[-1]
            tags.append(tag)
            parents.append(up)
            self.weight.append(weight)
            self.names.append(names)
            self.gone.append(self.gone[up] or hidden or (tag == "dialog" and not is_open))
            stack.append(len(tags) - 1)
            for k in groups(tag):
                places.setdefault(k, []).append(len(stack) - 1)


class Blocks:
    """The page's blocks of text: element, text, characters in links; and each element's path and prior."""

    def __init__(self, page: Page):
        self.page = page
        nodes = [x for x in page.nodes if not page.gone[x[0]]]
        self.element, self.text, self.plain = [], [], []
        i = 0
        while i < len(nodes):
            j, parts, plain, size, element = i, [], 0, 0, -1
            while j < len(nodes) and nodes[j][2] == nodes[i][2]:
                e, t, _, link = nodes[j]
                parts.append(unescape(t))
                if n := len(t.strip()):
                    size += n
                    plain += 0 if link else n
                    element = e if element < 0 else min(element, e)
                j += 1
            text = " ".join("".join(parts).split())
            if text and element >= 0:
                while page.tag[element] not in BLOCKS and element:
                    element = page.parent[element]
                self.element.append(element)
                self.text.append(text)
                self.plain.append(plain / size)
            i = j
        self._priors()

    def _priors(self) -> None:
        """Per element: the number of its path, whether an article is around it, and the weight of its tags and names."""
        tags, parents, named = self.page.tag, self.page.parent, self.page.weight
        weight = [0.0] * len(tags)
        around = [False] * len(tags)  # an article or main element lies inside
        for e, t, plain in zip(self.element, self.text, self.plain):
            weight[e] += plain * len(t)
        for e in range(len(tags) - 1, 0, -1):
            weight[parents[e]] += weight[e]
            around[parents[e]] |= around[e] or tags[e] in ("article", "main")
        numbers: dict[tuple[int, str, str], int] = {}
        self.path, self.prior = [0] * len(tags), [1.0] * len(tags)
        self.inside, self.part = [False] * len(tags), [0] * len(tags)
        inside = [False] * len(tags)
        for e in range(1, len(tags)):
            up, tag = parents[e], tags[e]
            # A name on what holds the article (or most of the text, where no element is marked as one) speaks of layout.
            layout = around[e] or tag in ("main", "body") or not (around[0] or 2 * weight[e] < weight[0])
            own = 1.0 if layout else named[e]
            if tag in ASIDE or (tag == "header" and not inside[up]):
                own = NEVER
            inside[e] = inside[up] or tag in ("article", "main")
            self.inside[e] = self.inside[up] or tag == "article"
            up_prior = self.prior[up]
            best = max(up_prior, ARTICLE if tag == "article" else MAIN if tag == "main" else 1.0)
            self.prior[e] = min(up_prior, own) if min(up_prior, own) < 1 else best
            self.part[e] = e if tag == "article" or (tag in PARTS and self.page.names[e]) else self.part[up]
            self.path[e] = numbers.setdefault((self.path[up], tag, self.page.names[e]), len(numbers) + 1)

    def priors(self) -> np.ndarray:
        return np.array([self.prior[e] for e in self.element])

    def ratios(self) -> np.ndarray:
        """The fused and smoothed ratio of each block's path. A path's blocks of links are told from its others."""
        keys = [(self.path[e], plain < 1 / 3) for e, plain in zip(self.element, self.plain)]
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        of = np.array([number[k] for k in keys])
        count = np.bincount(of)
        chars = np.array([len(t) for t in self.text], float)
        plain = np.array(self.plain)
        chars *= plain + LINKED * (1 - plain)
        marks = plain * np.array([len(PUNCTUATION.findall(t)) for t in self.text], float)
        total = np.bincount(of, weights=chars)
        fused = total / count * (1 + np.bincount(of, weights=marks) / count) * np.sqrt(total / total.sum())
        value, part = np.log(fused[of]), np.array([self.part[e] for e in self.element])
        same = part[1:] == part[:-1]
        before, after = value.copy(), value.copy()  # a neighbour in another part lowers a block, but does not lift it
        before[1:] = np.where(same, value[:-1], np.minimum(value[:-1], value[1:]))
        after[:-1] = np.where(same, value[1:], np.minimum(value[:-1], value[1:]))
        smooth = (before + 2 * value + after) / 4
        return np.exp((np.bincount(of, weights=smooth) / count)[of])

    def scores(self) -> np.ndarray:
        """The ratio of each block's path, times its prior, which weighs more where there is little text to tell by."""
        return self.ratios() * self.priors() ** (1 + SPARSE / sum(map(len, self.text)))


def _around(page: Page, elements: list[int]) -> int:
    """The lowest element around all of these; a parent has a smaller number than its children."""
    held = [0] * len(page.tag)
    for e in elements:
        held[e] += 1
    for e in range(len(held) - 1, 0, -1):
        if held[e] == len(elements):
            return e
        held[page.parent[e]] += held[e]
    return 0


def extract(html: str | None) -> str:
    """The main text: blocks in page order, one per line; empty if there is none."""
    page = Page(html or "")
    blocks = Blocks(page)
    if not blocks.text:
        return ""
    tags, parents = page.tag, page.parent
    score, prior = blocks.scores(), blocks.priors()
    if not score.max() > 0:
        return ""
    content = score >= LEAST * score.max()
    top = _around(page, [blocks.element[i] for i in np.flatnonzero(content)])
    if blocks.inside[top]:
        while tags[top] != "article":
            top = parents[top]
    while tags[top] not in BLOCKS - TEXT - {"li"} and top:  # a paragraph is not an article
        top = parents[top]
    # Headings and paragraphs beside the content belong to it.
    beside: dict[int, set[int]] = {}
    for e in {e for e, p in zip(blocks.element, prior) if p >= 1}:
        if tags[e] in BESIDE:
            beside.setdefault(parents[e], set()).add(e)
    while top and tags[top] != "main" and tags[top] != "body":
        up = parents[top]
        if beside.get(up) and (tags[top] != "article" or tags[up] == "main"):
            top = up
        else:
            break
    # Parts of their own, without any content.
    holds, faint, links = [False] * len(tags), [True] * len(tags), [True] * len(tags)
    for e, x, plain in zip(blocks.element, score / score.max(), blocks.plain):
        holds[e] |= bool(x >= LEAST)
        faint[e] &= bool(x < FAINT)
        links[e] &= plain < 1 / 3
    for e in range(len(tags) - 1, top, -1):
        up = parents[e]
        holds[up], faint[up], links[up] = holds[up] or holds[e], faint[up] and faint[e], links[up] and links[e]
    inside, apart = [False] * len(tags), [False] * len(tags)
    for e in range(top, len(tags)):
        up, tag = parents[e], tags[e]
        inside[e] = e == top or (e > top and inside[up])
        if inside[e] and e != top:
            own = page.weight[e] < 1 or tag == "article" or (tag in ("ul", "ol", "div") and links[e] and not blocks.inside[e])
            own |= blocks.part[e] == e and faint[e] and tags[up] != "header"
            apart[e] = apart[up] or (own and not holds[e])
    keep = [inside[e] and p > NEVER and (bool(c) or not apart[e]) for e, c, p in zip(blocks.element, content, prior)]
    return "\n".join(t for t, k in zip(blocks.text, keep) if k)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Input columns without the html, plus text and n_chars (its code points). Columns of these names are replaced.

    Null and empty html and pages without text give an empty text. Whole pages of any length are read, one at a time, in
    one narrow stage; other columns, nulls in them and repeated rows pass through. An empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = [extract(x.as_py()) for x in rb.column(n)]
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(n)), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*kept, "text", "n_chars"])

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    return pages.select(*kept, F.col(html_col).alias("_html")).mapInArrow(run, f"{kinds}text string, n_chars long")
