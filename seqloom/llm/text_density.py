"""Main text of HTML pages by composite text density.

Every element of a page gets its characters per tag, adjusted by links: an element whose characters stand
in links is worth less, by a logarithm whose base grows with the share of links in the element and in the
whole body. The densities of an element's children (text that stands in it directly counts as one child)
add up to its density sum. The subtree with the largest sum is the content; the smallest density on its
path up to the body is the threshold, and every other element that reaches it gives the subtree with the
largest sum below it, too. A subtree inside an `article` or `main` element grows to that element.

Elements that are never main text (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments, by tag, role, class or id) count for nothing and are not returned.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm.common import map_slices, table

# Elements by the part they play in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is characters up to their end tag.
RAW = frozenset("script style title textarea iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label menu nav noembed noframes noscript object "
    "script select style svg template textarea title video".split()
)
#: A start tag on the left ends an open element on the right, unless one of BOUNDS lies in between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table select body menu dir".split())
#: Roles, and words of classes and ids, of what is not main text.
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NEVER_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: An article that has one of these is a reader's comment.
COMMENT_WORDS = frozenset("comment comments reply".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S
)
#: What a page that stops inside a tag or comment leaves.
UNENDED = re.compile(r"<(?:/?[A-Za-z]|[!?])")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|$))", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ENDING = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I | re.A) for tag in RAW}
#: The least base of the logarithm: nearer to 1, a few characters without a link would outweigh a whole text.
LEAST_BASE = 2.0


class Page:
    """The elements of a page as parallel lists in page order (0 is the body), and its text in pieces."""

    def __init__(self, source: str):
        self.tag, self.parent, self.never = ["body"], [-1], [False]
        self.direct = [0]
        #: (element, text); None marks the edge of a block.
        self.pieces: list[tuple[int, str] | None] = []
        self.stack = [0]
        #: Open elements by tag, and open inline ones by tag and number of open blocks.
        self.open: Counter = Counter({"body": 1})
        self.blocks = 1
        self.read(source)

    def read(self, source: str) -> None:
        at, last = 0, source.rfind(">") + 1
        while True:
            token = TOKEN.search(source, at, last)
            if token is None:
                break
            self.text(source[at : token.start()])
            at = token.end()
            if token[2] is None:
                continue
            name = token[2].lower()
            if token[1]:
                self.end(name)
            elif self.start(name, token[3]) and name in RAW:
                ended = ENDING[name].search(source, at)
                at = ended.end() if ended else len(source)
                self.end(name)
        rest = source[at:]
        cut = UNENDED.search(rest)
        self.text(rest[: cut.start()] if cut else rest)

    def text(self, raw: str) -> None:
        if raw and not raw.isspace():
            if self.tag[self.stack[-1]] == "head":
                self.end("head")
            clear = html.unescape(raw)
            self.direct[self.stack[-1]] += len(" ".join(clear.split()))
            self.pieces.append((self.stack[-1], clear))
        elif raw:
            self.pieces.append((self.stack[-1], " "))

    def start(self, name: str, attributes: str) -> bool:
        if name in ("html", "body"):
            self.leave("head")
            return False
        if name not in IN_HEAD and name != "head":
            self.leave("head")
        if name in BLOCKS:
            self.leave("p")
            for ended in ENDS.get(name, ()):
                self.leave(ended, BOUNDS)
            self.pieces.append(None)
        elif name == "br":
            self.pieces.append((self.stack[-1], "\n"))
        above = self.stack[-1]
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(above)
        self.never.append(self.never[above] or self.unwanted(name, attributes))
        self.direct.append(0)
        if name in VOID:
            return False
        self.stack.append(node)
        self.open[name] += 1
        if name in BLOCKS:
            self.blocks += 1
        else:
            self.open[name, self.blocks] += 1
        return True

    def unwanted(self, name: str, attributes: str) -> bool:
        within = bool(self.open["article"] or self.open["main"])
        if name in NEVER or (name == "header" and not within):
            return True
        if not attributes or name == "main":
            return False
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and UNSEEN.search(value)):
                return True
            if key == "role" and value in NEVER_ROLES:
                return True
            if key in ("class", "id"):
                words = set(re.split("[^a-z0-9]+", value))
                if name == "article":
                    words &= COMMENT_WORDS
                elif within:
                    words -= {"header"}
                if words & NEVER_WORDS or words & COMMENT_WORDS:
                    return True
        return False

    def pop(self) -> str:
        name = self.tag[self.stack.pop()]
        self.open[name] -= 1
        if name in BLOCKS:
            self.blocks -= 1
            self.pieces.append(None)
        else:
            self.open[name, self.blocks] -= 1
        return name

    def leave(self, name: str, bounds: frozenset = BOUNDS) -> None:
        """Ends the innermost open `name` with all in it, unless one of `bounds` was opened inside it."""
        if not self.open[name]:
            return
        for node in reversed(self.stack):
            if self.tag[node] == name:
                break
            if self.tag[node] in bounds:
                return
        while self.pop() != name:
            pass

    def end(self, name: str) -> None:
        """An end tag without its start is ignored; that of an inline element does not end blocks inside it."""
        if name in ("html", "body") or not (self.open[name] if name in BLOCKS else self.open[name, self.blocks]):
            return
        while self.pop() != name:
            pass


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Composite density and density sum of every element."""
    n = len(page.tag)
    chars = [0 if never else own for own, never in zip(page.direct, page.never)]
    tags, linked, links = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.never[i]:
            continue
        up = page.parent[i]
        if page.tag[i] == "a":
            linked[i] = chars[i]
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        linked[up] += linked[i]
        links[up] += links[i] + (page.tag[i] == "a")
    share = linked[0] / max(chars[0], 1)

    def composite(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        t = max(t, 1)
        base = max(log(c / max(c - lc, 1) * lc + share * c + e), LEAST_BASE)
        return c / t * log(c / max(lc, 1) * t / max(lt, 1)) / log(base)

    density = [0.0 if page.never[i] else composite(chars[i], tags[i], linked[i], links[i]) for i in range(n)]
    sums = [composite(page.direct[i], 1, page.direct[i] if page.tag[i] == "a" else 0, 1) if not page.never[i] else 0.0 for i in range(n)]
    for i in range(n - 1, 0, -1):
        sums[page.parent[i]] += density[i]
    return density, sums


def content(page: Page) -> list[bool]:
    """Which elements belong to the main text."""
    n = len(page.tag)
    density, sums = densities(page)
    #: The element with the largest sum in each subtree; of equal ones the outermost, then the first.
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        held = best[up]
        if sums[best[i]] > sums[held] or (sums[best[i]] == sums[held] and held != up):
            best[up] = best[i]
    least, i = density[best[0]], best[0]
    while i > 0:
        i = page.parent[i]
        least = min(least, density[i])
    # The threshold is followed down from the body: below an element under it, nothing more is chosen.
    reached, chosen = [True] * n, [False] * n
    for i in range(n):
        reached[i] = (i == 0 or reached[page.parent[i]]) and density[i] >= least and not page.never[i]
        if reached[i]:
            chosen[best[i]] = True
    # The nearest article or main around each element.
    around = [0] * n
    for i in range(1, n):
        around[i] = i if page.tag[i] in ("article", "main") else around[page.parent[i]]
        if chosen[i] and around[i]:
            chosen[around[i]] = True
    for i in range(1, n):
        chosen[i] = (chosen[i] or chosen[page.parent[i]]) and not page.never[i]
    return chosen


def main_text(source: str | None) -> str:
    """Main text of a page, a line for each block; empty where there is none."""
    if not source:
        return ""
    page = Page(source)
    wanted = content(page)
    blocks: list[str] = []
    parts: list[str] = []
    for piece in [*page.pieces, None]:
        if piece is not None:
            if wanted[piece[0]]:
                parts.append(piece[1])
        elif parts:
            line = " ".join("".join(parts).split())
            if line:
                blocks.append(line)
            parts = []
    return "\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of `pages`.

    A null, empty or textless page gives an empty text; rows repeat as they repeat in `pages`, columns of other
    names are left out, and nulls in page_id and url stay. Pages are handled one by one, whatever their length, and
    nothing is shuffled. A page that stops in the middle of a tag or comment loses that tag or comment.
    """

    def work(batch: pa.RecordBatch) -> dict:
        texts = [main_text(source) for source in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_slices(pages.select("page_id", "url", "html"), work, f"page_id {kind}, url string, text string, n_chars bigint", text="html")


#: What the query gives on pages that mark their article as such and use no other character references than
#: these: the article's blocks. The densities themselves are beyond SQL.
OP11_SQL = r"""
WITH article AS (SELECT page_id, url, row_number() OVER () AS row_id, coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '') AS body FROM pages),
parts AS (SELECT row_id, generate_subscripts(p, 1) AS place, unnest(p) AS part
  FROM (SELECT row_id, regexp_split_to_array(body, '</?(?:p|h[1-6]|li|ul|ol|div|section|blockquote)>') AS p FROM article)),
lines AS (SELECT row_id, place, trim(regexp_replace(replace(replace(replace(replace(
    regexp_replace(replace(part, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS line FROM parts),
texts AS (SELECT row_id, string_agg(line, chr(10) ORDER BY place) AS text FROM lines WHERE line <> '' GROUP BY row_id)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM article LEFT JOIN texts USING (row_id)
"""


def op11_text_density(spark, folder):
    return extracted(table(spark, folder, "pages"))
