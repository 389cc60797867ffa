"""Main text of web pages by composite text density.

Every node of the page has a density: its characters per tag, adjusted for links. A node's density sum is that
of its children's densities, and the node with the largest sum is the article. The lowest density on the path
from it to the body is the threshold that siblings must reach to belong to it as well. Navigation, forms,
notices and the like are left out of the tree from the start, by tag, role, class or id.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = re.compile(r"<!--|<!\[CDATA\[|</?[a-zA-Z]|<[!?/]")
#: Possessive, so that no text is read twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+)>""")
BARE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
DEPTH = 512  # elements deeper than this are read as if they were not there, as browsers do; their text stays
MARK = re.compile(r"""(?:\b(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))|\b(hidden)\b""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style noscript template iframe nav footer aside form button select textarea svg canvas object dialog menu title xmp".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|notices?"
    r"|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|replies|discuss\w*|disqus|login|search)(?:$|[\s_-])",
    re.I,
)
NOISE_IN_ARTICLE = re.compile(NOISE.pattern.replace("|header|", "|"), re.I)  # an article's header has its title
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
SCOPES = frozenset("table td th caption button object template select".split())  # an end tag in them ends nothing around them
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in MARK.finditer(attributes):
        name, value = (m[1] or "hidden").lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "role" and value.lower() in ROLES or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and (NOISE_IN_ARTICLE if in_article else NOISE).search(value):
            return True
    return False


def _left_open(skipped: list[str], name: str) -> int:
    """How many of the open tags are left when an element of this name starts: those it ends, and all in them, go."""
    left = len(skipped)
    for ends, stop in (({"p"}, BLOCK), (CLOSES.get(name, set()), {"ul", "ol", "dl", "table", "select"})):
        if name not in BLOCK and name not in CLOSES:
            break
        for k in range(left - 1, -1, -1) if ends else ():
            if skipped[k] in ends:
                left = k
            elif skipped[k] in stop:
                break
    return left


class Page:
    """Nodes in page order as parallel lists; blocks of text, each node with its first and end block."""

    def __init__(self, source: str):
        self.tag, self.parent, self.block = ["#root"], [-1], [True]
        self.chars, self.links, self.tags, self.link_tags = [0], [0], [0], [0]
        self.first, self.end = [0], [0]
        self.blocks: list[str] = []
        self._run: list[str] = []
        self._read(source)

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            self._run = []
            if text:
                self.blocks.append(text)

    def _read(self, source: str) -> None:
        open_: list[int] = [0]  # nodes
        opened: Counter[str] = Counter()  # how many of each name are open
        skipped: list[str] = []  # open tags in what is dropped
        articles = links = 0
        at, n, last, last_open = 0, len(source), source.rfind(">"), source.rfind("<")
        tag, parent = self.tag, self.parent

        def text(piece: str) -> None:
            if "&" in piece:
                piece = entities.unescape(piece)
            self._run.append(piece)
            count = len("".join(piece.split()))
            if count:
                self.chars[open_[-1]] += count
                if links:
                    self.links[open_[-1]] += count

        def close() -> None:
            nonlocal articles, links
            k = open_.pop()
            if self.block[k]:
                self._flush()
            self.end[k] = len(self.blocks)
            opened[tag[k]] -= 1
            articles -= tag[k] in ("article", "main")
            links -= tag[k] == "a"

        def after(end: str, start: int) -> int:
            k = source.find(end, start)
            return k + len(end) if k >= 0 else n

        while at < n:
            m = START.search(source, at)
            if m is None or m.start() > at:
                stop = m.start() if m else n
                if not skipped:
                    text(source[at:stop])
                if m is None:
                    break
            at, mark = m.start(), m[0]
            if mark == "<!--" or mark == "<![CDATA[":
                at = after("-->" if mark == "<!--" else "]]>", m.end())
                continue
            if at > last:  # never ended: text, but for a tag that the page's end cuts off
                if mark[-1].isalpha() and at == last_open:
                    break
                if not skipped:
                    text(mark)
                at = m.end()
                continue
            if not mark[-1].isalpha():
                at = after(">", at)
                continue
            if found := TAG.match(source, at):
                shut, name, attributes = found.groups()
                at = found.end()
            else:  # a quote or an angle that is out of place
                shut, name = (found := BARE.match(source, at)).groups()
                at = after(">", found.end())
                attributes = source[found.end() : at - 1]
            name = name.lower()
            ended = False  # what is skipped, by this tag
            if skipped:
                if shut:
                    if name in skipped:
                        while skipped.pop() != name:
                            pass
                    elif name in BLOCK and name not in ("body", "html") and not SCOPES & set(skipped) and opened[name]:
                        skipped.clear()  # ended with its parent
                        ended = True
                elif name in RAW:
                    e = RAW[name].search(source, at)
                    at = e.end() if e else n
                elif name not in VOID and not (left := _left_open(skipped, name)):
                    skipped.clear()  # the new element ends it, and is judged by itself
                    ended = True
                elif name not in VOID and not attributes.endswith("/"):
                    skipped[left:] = [name]
                    del skipped[DEPTH:]
                if ended:
                    pass
                elif name in ("body", "article", "main") and (skipped and skipped[0] == "head" or not skipped):
                    if not shut:
                        skipped.clear()  # a head that was never closed
                    else:
                        continue
                else:
                    continue
            if shut:
                if opened[name]:
                    while tag[open_[-1]] != name:
                        close()
                    close()
                elif name in BLOCK:
                    self._flush()
                continue
            if name in RAW:
                e = RAW[name].search(source, at)
                at = e.end() if e else n
                continue
            if name == "br":
                self._run.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    self._flush()
                continue
            if name in BLOCK:
                for k in range(len(open_) - 1, 0, -1) if opened["p"] else ():  # a block ends an open paragraph
                    t = tag[open_[k]]
                    if t == "p":
                        while len(open_) > k:
                            close()
                        break
                    if t in BLOCK:
                        break
                for k in range(len(open_) - 1, 0, -1) if name in CLOSES else ():
                    t = tag[open_[k]]
                    if t in CLOSES[name]:
                        while len(open_) > k:
                            close()
                        break
                    if t in ("ul", "ol", "dl", "table", "select"):
                        break
                self._flush()
            if _noise(name, attributes, articles > 0):
                if not attributes.endswith("/"):
                    skipped = [name]
                continue
            if len(open_) > DEPTH:
                continue
            k = len(tag)
            opened[name] += 1
            tag.append(name)
            parent.append(open_[-1])
            self.block.append(name in BLOCK)
            for x in (self.chars, self.links, self.tags, self.link_tags):
                x.append(0)
            self.first.append(len(self.blocks))
            self.end.append(len(self.blocks))
            articles += name in ("article", "main")
            links += name == "a"
            open_.append(k)
            if attributes.endswith("/") and name not in BLOCK:
                close()
        while open_:
            close()

    def main_text(self) -> str:
        n, parent = len(self.tag), self.parent
        C, L, T, A = self.chars[:], self.links[:], self.tags[:], self.link_tags[:]
        for k in range(n - 1, 0, -1):
            p = parent[k]
            C[p] += C[k]
            L[p] += L[k]
            T[p] += T[k] + 1
            A[p] += A[k] + (self.tag[k] == "a")
        if not self.blocks:
            return ""
        body = next((k for k in range(n) if self.tag[k] == "body"), 0)
        ratio = L[body] / max(1, C[body])

        def density(k: int) -> float:
            c, lc, t, lt = C[k], L[k], max(1, T[k]), max(1, A[k])
            if not c:
                return 0.0
            # One is added to the base, so that a page without links has finite densities.
            base = 1 + math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)

        dense = [density(k) for k in range(n)]
        total = [0.0] * n
        for k in range(1, n):
            if self.block[k]:
                total[parent[k]] += dense[k]
        inside = [False] * n
        for k in range(n):
            inside[k] = k == body or k and inside[parent[k]]
        nodes = [k for k in range(n) if inside[k] and self.block[k] or k == body]
        best = max(nodes, key=lambda k: (total[k], -k))
        path, k = [], best
        while k != body and k > 0:
            path.append(k)
            k = parent[k]
        path.append(body)
        least = min(dense[k] for k in path)
        if self.tag[best] not in ("article", "main") and (owner := [k for k in path if self.tag[k] in ("article", "main")]):
            best = owner[-1] if len(owner) == 1 else owner[0]
        chosen = {best}
        with_paragraph = {parent[j] for j in range(1, n) if self.tag[j] == "p"}
        siblings = [k for k in nodes if k != best and best != body and parent[k] == parent[best]]
        for k in siblings:
            paragraphs = self.tag[k] in ("p", "h1") or k in with_paragraph
            if self.tag[k] == "h1" and k < best or paragraphs and dense[k] >= least and L[k] * 3 <= C[k] and self.tag[best] not in ("article", "main"):
                chosen.add(k)
        low, high = min(chosen), max(chosen)
        chosen |= {k for k in siblings if low < k < high and L[k] * 3 <= C[k]}
        keep: list[str] = []
        for k in sorted(chosen):
            keep += self.blocks[self.first[k] : self.end[k]]
        return "\n\n".join(keep)


def main_text(source: str | None) -> str:
    """Blocks in page order, white space collapsed, joined by two newlines; empty if there are none."""
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages, from the whole html.

    Null or empty html, or a page without text outside navigation and the like, gives an empty text of 0
    characters. Broken markup is read as browsers do in the main, in time linear in the page: open elements end with
    their parent, what is no tag is text, and elements more than DEPTH deep are left out, but not their text. Repeated rows give repeated rows; further columns are not read.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return rows.mapInPandas(run, schema)
