"""Main text of web pages by tree scoring: paragraphs pass points to their ancestors, and the best container is kept."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = ("script", "style", "textarea", "noscript", "template", "iframe", "title", "xmp")
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never part of an article.
_DROPPED = frozenset("nav footer aside form script style noscript template iframe button select option textarea svg canvas object dialog menu head title label input fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
#: What a class or id may name that isn't the article: its noun, the last of its words that says something.
_OTHER = frozenset("advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr masthead modal navbar newsletter pager pagination popup promo promoted replies respond responses sidebar signup sponsor sponsored subscribe".split())
#: Nouns that do so only in a class or id made of them, of those above and of words that say nothing: "share-buttons", but not "social-history".
_ALONE = frozenset("ad ads banner footer menu nav navigation notice overlay related share sharing social toolbar widget".split())
_PLAIN = frozenset("area bar block body bottom box button buttons container content form global header icons inner item items layout left link links list main outer page post primary right row secondary section site slot title top unit wrap wrapper".split())
#: Words before which a class names no element but a state of the page.
_STATES = frozenset("has is no with without".split())
#: With one of the first in front, the second are links to other pages.
_MORE, _PAGES = frozenset("recommended related".split()), frozenset("article articles content links news pages posts reading stories".split())
_GOOD = frozenset("article body content entry main page post story text".split())
_PARAGRAPHS = frozenset("p pre td blockquote dd li figcaption".split())
_CONTAINERS = frozenset("div section article main body".split())
_PROSE = frozenset("p pre blockquote".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KEPT_WHOLE = frozenset("html body main".split())
#: Elements that tell an article: what holds one isn't beside it.
_TELLING = frozenset("main h1 article".split())
#: A start tag that ends an open element of these, unless one of the stops is met first.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_CLOSED_P = _BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}


def _words(name: str) -> list[str]:
    return [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if x]


def _marks(names: str) -> tuple[bool, bool]:
    """Do classes and ids name other content; do they name the article?"""
    other, alone, good = False, False, False
    for words in map(_words, names.split()):
        if not words or words[0] in _STATES:
            continue
        telling = [x for x in words if x not in _PLAIN]
        if telling and (telling[-1] in _OTHER or (telling[0] in _MORE and len(telling) > 1 and not set(telling[1:]) - _PAGES)):
            other = True
        elif telling and not set(telling) - _ALONE - _OTHER:
            alone = True
        else:
            good |= bool(_GOOD.intersection(words))
    return other or (alone and not good), good


class Page:
    """A page as flat lists: nodes with parents before their children, and runs of text in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.drop, self.weight, self.suspect = ["#root"], [-1], [False], [0], [False]
        self.runs: list[tuple[int, int, bool, str]] = []  # node, block, in a link, raw text
        stack, block, at, link = [0], 0, 0, 0
        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue  # inside a raw element
            if m.start() > at:
                self.runs.append((stack[-1], block, link > 0, source[at : m.start()]))
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag in _BLOCK:
                    block += 1
                floor = 1 if tag in _BLOCK else next((i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] in _BLOCK), 0) + 1
                for i in range(len(stack) - 1, floor - 1, -1):
                    if self.tag[stack[i]] == tag:
                        del stack[i:]
                        break
                if tag == "a" or tag in _BLOCK:
                    link = 0
                continue
            if tag in _VOID:
                if tag == "br":
                    self.runs.append((stack[-1], block, False, " "))
                block += tag == "hr"
                continue
            if tag in _RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in _BLOCK:
                block, link = block + 1, 0
                if tag in _CLOSED_P:
                    self._end(stack, ("p",), ("td", "th", "table", "button"))
                if tag in _ENDS:
                    self._end(stack, *_ENDS[tag])
            if tag == "a":
                link = 1
            if m[3].rstrip().endswith("/") and tag not in _BLOCK:
                continue
            stack.append(self._open(tag, m[3], stack[-1]))
        if at < len(source):
            self.runs.append((stack[-1], block, link > 0, source[at:]))

    def _end(self, stack: list[int], tags: tuple, stops: tuple) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in tags:
                del stack[i:]
                return
            if self.tag[stack[i]] in stops:
                return

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        drop, weight, suspect = tag in _DROPPED and tag != "form", 25 if tag in ("article", "main") else 0, tag == "form"
        if attributes.strip():
            names = ""
            for name, a, b, c in _NAMES.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id"):
                    names += f" {value}"
                elif tag in _KEPT_WHOLE or tag == "article":
                    continue
                elif name == "role":
                    drop |= value.strip().lower() in _ROLES
                elif name == "style":
                    drop |= "display:none" in value.replace(" ", "").lower()
                elif name == "hidden" or value.strip().lower() == "true":
                    drop = True
            if names:
                other, good = _marks(names)
                suspect |= tag not in _KEPT_WHOLE and other
                weight += 25 * good
        self.tag.append(tag)
        self.parent.append(parent)
        self.drop.append(drop or self.drop[parent])
        self.weight.append(weight)
        self.suspect.append(suspect)
        return len(self.tag) - 1

    def inside(self, tags: tuple) -> list[bool]:
        """Of each node: is it, or lies it in, an element of ``tags``?"""
        out = [False] * len(self.tag)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] or self.tag[i] in tags
        return out

    def _article(self, best: int, prose: list[bool]) -> int:
        """The element whose undropped blocks are the article that the container ``best`` is a part of.

        That is the outermost <article> around it, or <main>; where there is neither, it is the ancestor reached
        through <div> and <section> parents that hold more prose: paragraphs, or sections beside a section."""
        tag, parent = self.tag, self.parent
        found, at = {}, best
        while at > 0:
            found[tag[at]] = at
            at = parent[at]
        if "article" in found or "main" in found:
            return found.get("article") or found["main"]
        paragraphs, sections = [0] * len(tag), [0] * len(tag)
        for i in range(1, len(tag)):
            if prose[i]:
                paragraphs[parent[i]] += tag[i] in _PROSE
                sections[parent[i]] += tag[i] == "section"
        while best and tag[up := parent[best]] in ("div", "section") and (paragraphs[up] > (tag[best] in _PROSE) or (tag[best] == "section" and sections[up] > 1)):
            best = up
        return best

    def _beside(self, drop: list[bool]) -> list[bool]:
        """``drop``, and the elements whose name (or being a form) says that they stand beside the article, with all inside.

        One that holds a main, a heading of the first level or an article that isn't suspect itself never goes, nor one
        with most of the page's prose while none of these with text stands elsewhere."""
        count, parent, tag = len(self.tag), self.parent, self.tag
        prose, telling = [0] * count, [False] * count
        for node, _, link, run in self.runs:
            if not drop[node] and not link:
                prose[node] += len(run.strip())
        for i in range(count - 1, 0, -1):
            telling[i] = telling[i] or (tag[i] in _TELLING and not self.suspect[i] and prose[i] > 0 and not drop[i])
            prose[parent[i]] += prose[i]
            telling[parent[i]] |= telling[i]
        out = list(drop)
        for i in range(1, count):
            most = not telling[0] and 2 * prose[i] > prose[0]
            out[i] = out[i] or out[parent[i]] or (self.suspect[i] and not telling[i] and not most)
        return out

    def text(self) -> str:
        """The article's text; if all of the page seems to stand beside one, that of its best part."""
        headers, articles = self.inside(("header",)), self.inside(("article", "main"))
        drop = [d or (h and not a) for d, h, a in zip(self.drop, headers, articles, strict=True)]
        return self._text(self._beside(drop)) or self._text(drop)

    def _text(self, drop: list[bool]) -> str:
        """The text of the article around the best container, and its good siblings', block by block."""
        count, parent, tag, drop = len(self.tag), self.parent, self.tag, list(drop)
        own: list[list[int]] = [[0, 0, 0, 0] for _ in range(count)]  # characters, commas, characters in links, links
        home = [0] * count  # the nearest block element, itself included
        for i in range(1, count):
            home[i] = i if tag[i] in _BLOCK else home[parent[i]]
        for node, _, link, run in self.runs:
            if drop[node] or not (n := len(run.strip())):
                continue
            o = own[home[node]]
            o[0] += n
            o[1] += run.count(",") + run.count("，") + run.count("、")
            o[2] += n * link
            o[3] += link
        whole, links, anchors = [x[0] for x in own], [x[2] for x in own], [x[3] for x in own]
        for i in range(count - 1, 0, -1):
            whole[parent[i]] += whole[i]
            links[parent[i]] += links[i]
            anchors[parent[i]] += anchors[i]
        score: dict[int, float] = {}
        for i in range(count):
            n, commas, in_links, _ = own[i]
            if not n or drop[i]:
                continue
            points = (min(1.0, n / 25) + commas + min(3, n // 100)) * (1 - in_links / n)
            holder = i if tag[i] in _CONTAINERS or i == 0 else parent[i]
            if tag[i] not in _PARAGRAPHS and tag[i] not in _CONTAINERS and i:
                points *= 0.5  # headings and the like
            for step in (1.0, 0.5, 1 / 3):
                if holder < 0:
                    break
                if holder not in score:
                    score[holder] = self.weight[holder]
                score[holder] += points * step
                holder = parent[holder]
        rated = {i: s * (1 - links[i] / max(1, whole[i])) for i, s in score.items() if not drop[i] and tag[i] in _CONTAINERS | {"#root", "td", "ul", "ol", "blockquote", "figure"}}
        if not rated:
            return ""
        best = max(rated, key=lambda i: (rated[i], -i))
        least = max(10.0, 0.2 * rated[best])
        prose = [whole[i] > 0 and not drop[i] and links[i] < 0.5 * whole[i] for i in range(count)]
        best = self._article(best, prose)
        keep = [False] * count
        for i in range(count):
            if i == best or (i and keep[parent[i]]):
                keep[i] = True
            elif i and best and parent[i] == parent[best] and not drop[i]:
                inner = tag[parent[i]] not in ("body", "html", "#root")
                keep[i] = rated.get(i, 0) >= least or (prose[i] and (tag[i] in _PROSE | _HEADINGS or tag[i] == tag[best] == "section" or (inner and tag[i] in _CONTAINERS)))
        menus = tag[best] not in ("article", "main")  # there, lists of links are the article's own, such as its references
        for i in range(1, count):  # elsewhere, lists of short links are menus
            if drop[parent[i]] or (menus and keep[i] and i != best and tag[i] in ("ul", "ol", "div", "section", "table") and links[i] > 0.7 * whole[i] > 0 and links[i] < 30 * anchors[i]):
                drop[i] = True
        blocks: list[list[str]] = []
        last = None
        for node, block, _, run in self.runs:
            if keep[node] and not drop[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(run)
        joined = (" ".join(html.unescape("".join(x)).split()) for x in blocks)
        return " ".join(x for x in joined if x)


def main_text(source: str | None) -> str:
    """The article of a page; empty if it has none."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to page_id, url, text, n_chars, one row a page, from the whole html.

    Null and empty html gives an empty text; pages with equal or null ids stay apart; of containers with equal scores
    (ties) the first is taken; pages of any length are read whole; broken markup is read as it comes: unclosed elements end with their parent, raw elements without an end run to the page's end. Other columns
    are ignored; work and memory follow the page's length."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda x: main_text(x if isinstance(x, str) else None))

    return pages.select("page_id", "url", text("html").alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
