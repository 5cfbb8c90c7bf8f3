"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: start tags and text runs, each told apart by the
path of open elements above it. Across the pages of one host every token has an
occurrence vector (how often it occurs on each page). Tokens with equal vectors
form an equivalence class; a class with enough pages and at least two tokens, one
of them a tag, is valid and belongs to the host's template. Open elements nest the
classes: a text run is the template's own if an element open above it is of the run's
class, so that it stands wherever that element stands. Text that some pages only share
as copies of one another has no such element. An element (a paragraph, say) that also
holds other text is content with all its words.

Vectors are never written out. Spark sums, per host and token, the number of pages
and two hashes of (page, count); equal vectors have equal sums. Hosts of any size
are spread by token.

A slot is an innermost open element of a valid class, or without one the innermost
block. If a page has ``article`` or ``main`` elements, its slots are main text inside
them. On other pages each slot is judged on the page itself: it is main text unless
half of its text or more is in links. Ids take no part in tokens, since many are
one page's own. Elements that are menus, headers, footers, sidebars, notices,
adverts, forms or comments by tag or by a word of their class or id are left out
everywhere.

Edge cases: null and empty html give the empty text; a page of a host with too few
pages for classes is read by its elements alone; unclosed and stray tags close as
browsers close them; repeated pages count as often as they occur; null urls are one
host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import slices, stage

# Roles of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg math iframe object"
LEFT_OUT = frozenset("head nav header footer aside form button select textarea dialog menu".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
# start tags that close an open element of these names first
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# Words in class, id and role that name something other than main text.
NOT_MAIN = frozenset(
    """ad ads adv advert advertisement adverts adsense banner breadcrumb breadcrumbs comment commentlist comments consent cookie
    cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination
    popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored
    subscribe toolbar widget widgets""".split()
)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW.split())})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def digest(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "replace")) - (1 << 63)


def names_of(attributes: str) -> tuple[str, bool, bool]:
    """Class and role of a tag, and whether a word of them or of the id names something other than main text, or main text."""
    if "=" not in attributes:
        return "", False, False
    found = [(name.lower(), a or b or c) for name, a, b, c in _NAMES.findall(attributes)]
    text = " ".join(x for _, x in found)
    return " ".join(x for name, x in found if name != "id"), any(w.lower() in NOT_MAIN for w in _WORD.findall(text)), "main" in text.lower().split()


class Page:
    """One pass over a page; text runs are reported with their place."""

    def __init__(self, source: str):
        self.runs: list[tuple[int, int, str, bool, bool, bool, int, int]] = []  # path, token, text, left out, in main, in a link, block, element
        self.elements: list[tuple[int, int, str]] = [(-1, 0, "")]  # element above, token, name
        self.tags: list[int] = []  # tokens of start tags
        self._read(source)

    def _read(self, source: str) -> None:
        # open elements: name, path, left out, in main, in a link, number
        stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, 0)]
        block = 0
        for match in _TOKEN.finditer(source):
            raw = match.group(1)
            name = match.group(3)
            if raw is not None:
                continue
            if name is None:
                text = match.group()
                if text[0] == "<":
                    if len(text) > 1:
                        continue
                    text = "<"
                _, path, out, main, link, element = stack[-1]
                text = entities.unescape(text)
                self.runs.append((path, digest(path, "text", " ".join(text.split())), text, out, main, link, block, element))
                continue
            name = name.lower()
            if match.group(2):
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if at:
                    if name not in INLINE:
                        block += 1
                    elif any(e[0] not in INLINE for e in stack[at + 1 :]):
                        continue  # an inline end tag closes no block
                    del stack[at:]
                elif name == "p":
                    block += 1
                continue
            if name not in INLINE:
                block += 1
            if name in ENDS_P:
                self._close(stack, {"p"}, {"article", "main", "div", "section", "td", "li", "body", "button"})
            if name in CLOSES:
                self._close(stack, CLOSES[name], {"ul", "ol", "dl", "table", "select", "menu"})
            _, path, out, main, link, above = stack[-1]
            label, other, named_main = names_of(match.group(4))
            here = digest(path, name, label) if name not in INLINE and name != "p" else path
            self.tags.append(digest(path, "tag", name, label))
            if name in VOID:
                continue
            if name in MAIN or named_main:
                out, main = False, True
            elif name in LEFT_OUT or other and name not in ("html", "body"):
                out = True
            self.elements.append((above, self.tags[-1], name))
            stack.append((name, here, out, main, link or name == "a", len(self.elements) - 1))

    @staticmethod
    def _close(stack: list, names: set[str], barrier: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in barrier:
                return

    def text(self, template: dict[int, int]) -> str:
        """Content of the main slots, block by block.

        ``template`` has the class of each token of a valid class. Elements that hold nothing but the template's own
        text runs are left out, unless they are most of the text: then the host's pages are copies of one another.
        """
        has_main = any(run[4] and not run[3] for run in self.runs)
        runs = [r for r in self.runs if not r[3] and (r[4] or not has_main)]
        if not has_main:
            plain: dict[int, int] = {}  # unlinked less linked characters of each slot
            for r in runs:
                slot = self._slot(r[7], template)
                plain[slot] = plain.get(slot, 0) + (-1 if r[5] else 1) * len(r[2].strip())
            runs = [r for r in runs if plain[self._slot(r[7], template)] > 0]
        mixed = {self._block(r[7]) for r in runs if r[2].strip() and not self._fixed(r, template)}
        own = [r for r in runs if self._block(r[7]) in mixed]
        if 2 * sum(len(r[2].strip()) for r in own) < sum(len(r[2].strip()) for r in runs):
            own = runs
        blocks: dict[int, list[str]] = {}
        for r in own:
            blocks.setdefault(r[6], []).append(r[2])
        whole = (" ".join("".join(parts).split()) for parts in blocks.values())
        return " ".join(b for b in whole if b)

    def _block(self, element: int) -> int:
        """The innermost element around that is not an inline one."""
        while self.elements[element][2] in INLINE:
            element = self.elements[element][0]
        return element

    def _fixed(self, run: tuple, template: dict[int, int]) -> bool:
        """Whether a text run is of the class of an element around it."""
        own, element = template.get(run[1]), run[7]
        while own is not None and element > 0:
            if template.get(self.elements[element][1]) == own:
                return True
            element = self.elements[element][0]
        return False

    def _slot(self, element: int, template: dict[int, int]) -> int:
        """The innermost block around that is a place of the template, or else the innermost block but paragraphs."""
        block = -1
        while element > 0:
            _, token, name = self.elements[element][:3]
            if name not in INLINE and name != "p":
                if token in template:
                    return element
                block = element if block < 0 else block
            element = self.elements[element][0]
        return max(block, 0)


def host_of(url: str | None) -> str:
    if not url:
        return ""
    return url.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()


TAG, TEXT, PAGE = 0, 1, 2


def occurrence_sums(pages: DataFrame) -> DataFrame:
    """``(host, kind, token, pages, s1, s2)``: number of pages and hash sums of each token's vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int, int], list[int]] = {}

        def add(key: tuple[str, int, int], n: int, a: int, b: int) -> None:
            held = sums.get(key)
            if held is None:
                sums[key] = [n, a, b]
            else:
                held[0] += n
                held[1] += a
                held[2] += b

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "kind", "token", "pages", "s1", "s2"])
            sums.clear()
            return out

        for frame in slices(frames, "html"):
            for page_id, url, source in frame[["page_id", "url", "html"]].itertuples(index=False, name=None):
                host = host_of(url)
                add((host, PAGE, 0), 1, 0, 0)
                if not source:
                    continue
                page, name = Page(source), digest(page_id, url)
                counts: dict[tuple[int, int], int] = {}
                for token in page.tags:
                    counts[TAG, token] = counts.get((TAG, token), 0) + 1
                for _, token, text, *_ in page.runs:
                    if text.strip():
                        counts[TEXT, token] = counts.get((TEXT, token), 0) + 1
                for (kind, token), n in counts.items():
                    h = digest(name, n) & 0x3FFFFFFFFFFFFFFF
                    add((host, kind, token), 1, h & 0x7FFFFFFF, h >> 31)
            if len(sums) > 200_000:
                yield flush()
        yield flush()

    found = pages.mapInPandas(run, "host string, kind int, token long, pages long, s1 long, s2 long")
    return found.groupBy("host", "kind", "token").agg(F.sum("pages").alias("pages"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def deduce(pages: DataFrame, min_pages: int = 3, min_share: float = 0.2) -> DataFrame:
    """``(host, template)``: tokens of valid classes, each with its class."""
    sums = stage(occurrence_sums(pages), "occurrence-sums")
    hosts = sums.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("all_pages"))
    tokens = sums.where(F.col("kind").isin(TAG, TEXT)).where(F.col("pages") >= min_pages).join(hosts, "host").where(F.col("pages") >= min_share * F.col("all_pages"))
    classes = tokens.groupBy("host", "pages", "s1", "s2").agg(F.count("*").alias("size"), F.max((F.col("kind") == TAG).cast("int")).alias("tags")).where("size >= 2 AND tags = 1")
    own = tokens.join(classes.select("host", "pages", "s1", "s2"), ["host", "pages", "s1", "s2"]).groupBy("host")
    return own.agg(F.collect_list(F.struct("token", F.xxhash64("pages", "s1", "s2").alias("class"))).alias("template"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_tokens: int = 500_000) -> DataFrame:
    """``(page_id, url, text)`` of every page. Templates are broadcast only if their measured size is small, else joined by host."""
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    templates = stage(deduce(named), "templates")
    size = templates.agg(F.sum(2 * F.size("template") + 4)).first()[0] or 0
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[^:/?#]*://)?([^/?#]*)", 1))
    joined = named.withColumn("host", host).join(F.broadcast(templates) if size <= broadcast_tokens else templates, "host", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[int, int]] = {}
        for frame in slices(frames, "html"):
            texts = []
            for name, source, template in frame[["host", "html", "template"]].itertuples(index=False, name=None):
                if not source:
                    texts.append("")
                    continue
                if name not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[name] = {} if template is None else {t["token"]: t["class"] for t in template}
                texts.append(Page(source).text(known[name]))
            yield frame[["page_id", "url"]].assign(text=texts)

    kind = named.schema["page_id"].dataType.simpleString()
    out = joined.select("page_id", "url", "html", "host", "template").mapInPandas(run, f"page_id {kind}, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text")
