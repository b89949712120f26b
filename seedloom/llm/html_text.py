"""HTML extraction by tree scoring."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from seedloom.llm.common import map_arrow

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math canvas object select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav header footer aside form button menu dialog head search".split())
#: A start tag of the key closes open elements of the set, up to the nearest element of SCOPES.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table div article section main body html blockquote".split())
# Parts of class, id and role names of what stands beside an article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus "
    "footer footnav gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo "
    "promoted promotion related replies respond share sharing sidebar skyscraper social sponsor sponsored subscribe taboola toolbar widget "
    "alert warning signup subscription paywall login complementary contentinfo search sidebox usercomments readercomments".split()
)
#: A class or id with one of these parts speaks of the page about an element, as in "layout-with-sidebar".
ABOUT = frozenset("with has no without hide show layout".split())
# Parts of names that say where or how an element stands, not what it holds.
PLACES = frozenset(
    "site page top bottom left right main primary secondary inner outer box bar area block section container wrapper wrap list item items content global local "
    "links link text label header footer sticky fixed floating mobile desktop small large first last default new row col column group panel zone slot unit region "
    "article post story entry body the a an and of by form button buttons icon icons message messages policy "
    "thread threads posts articles stories card cards tools tool cta callout mpu leaderboard rail strip stack feed count counter heading title tab tabs badge dialog".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_ANYWAY = frozenset(("html", "body", "article", "main"))

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*+>)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[a-z]+")
#: Points that an article or main element starts with, and its share of each paragraph's points by level above it.
ARTICLE_BONUS = 25.0
SIBLING_SHARE = 0.2
#: Share of an element's characters that must stand in sentences, headings or lists for an element of a doubtful name to be part of the article.
SENTENCES = 0.5
SENTENCE_END = re.compile(r"[.!?:;…。！？]['\"”’»)\]]*$")


def beside_article(name: str, attributes: str) -> int:
    """2 if an element's name, class, id, role or visibility marks it as no part of an article, 1 if its name may, else 0.

    The head of a name decides, its last part that isn't a place or form: "reader-comments" and "ad-slot-mpu" are
    boilerplate, "social-history" and "notice-period" may speak of an article's subject; the element's text decides.
    """
    if name in DROPPED:
        return 2
    if name in KEPT_ANYWAY or len(attributes) < 3:
        return 0
    found = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return 2
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
        if key in ("class", "id", "role"):
            for one in value.split():
                parts = NAME_PART.findall(one)
                if not BOILERPLATE.isdisjoint(parts) and ABOUT.isdisjoint(parts):
                    if next((p for p in reversed(parts) if p not in PLACES and len(p) > 1), parts[-1]) in BOILERPLATE:
                        return 2
                    found = 1
    return found


class Page:
    """Blocks of a page in order, each with its node, and a tree of nodes that holds them."""

    def __init__(self, by_class: bool = True) -> None:
        self.by_class = by_class
        self.names, self.parents = ["#page"], [-1]
        self.doubtful: list[int] = []
        self.blocks: list[tuple[int, str, int]] = []

    def parse(self, html: str) -> "Page":
        names, parents, blocks = self.names, self.parents, self.blocks
        stack, opened = [0], {}
        text: list[str] = []
        links = at = linked = 0
        skipped: int | None = None  # depth of the element being left out

        def flush() -> None:
            nonlocal links
            if text:
                words = "".join(text).split()
                if words:
                    owner = next(n for n in reversed(stack) if n == 0 or names[n] in BLOCK)
                    blocks.append((owner, " ".join(words), links))
                text.clear()
            links = 0

        def add(piece: str) -> None:
            nonlocal links
            if skipped is None and piece:
                piece = entities.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if linked:
                    links += len(piece.strip())

        def pop() -> None:
            nonlocal linked, skipped
            name = names[stack.pop()]
            opened[name] -= 1
            linked -= name == "a"
            if skipped is not None and len(stack) < skipped:
                skipped = None

        def close(targets: set[str]) -> None:
            if any(opened.get(t) for t in targets):
                for depth in range(len(stack) - 1, 0, -1):
                    name = names[stack[depth]]
                    if name in targets:
                        while len(stack) > depth:
                            pop()
                        return
                    if name in SCOPES:
                        return

        size = len(html)
        while at < size:
            found = TOKEN.search(html, at)
            if not found:
                add(html[at:])
                break
            add(html[at : found.start()])
            at = found.end()
            name = found[2]
            if not name:
                continue
            name = name.lower()
            if found[1]:
                if name in BLOCK:
                    flush()
                if opened.get(name):
                    while names[stack[-1]] != name:
                        pop()
                    pop()
                continue
            attributes = found[3][:-1]
            if name == "br" or name == "img":
                add(" ")
                continue
            if name in BLOCK:
                flush()
                if opened.get("p"):
                    close({"p"})
            if name in CLOSES:
                close(CLOSES[name])
            if name in VOID:
                continue
            if name in RAW and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if attributes.rstrip().endswith("/") and name not in BLOCK:
                continue
            names.append(name)
            parents.append(stack[-1])
            stack.append(len(names) - 1)
            opened[name] = opened.get(name, 0) + 1
            linked += name == "a"
            beside = 0 if skipped is not None else beside_article(name, attributes if self.by_class else "")
            if beside == 1:
                self.doubtful.append(len(names) - 1)
            elif beside:
                flush_before = text and name not in BLOCK
                if flush_before:
                    text.append(" ")
                skipped = len(stack)
        flush()
        return self

    def whole(self, best: int, chars: list[int], links: list[int]) -> tuple[int, bool]:
        """The container that holds all of the article that ``best`` is a part of, and whether the page names it so.

        That is the outermost article or main element around it; else the lowest container above
        it with other text that isn't linked and with most such text of the page.
        """
        names, parents = self.names, self.parents
        named, up = -1, best
        while up >= 0:
            if names[up] in ("article", "main"):
                named = up
            up = parents[up]
        if named >= 0:
            return named, True
        own = chars[best] - links[best]
        up = parents[best]
        while up >= 0:
            held = chars[up] - links[up]
            if held > own and 2 * held > chars[0] - links[0]:
                return up, False
            up = parents[up]
        return best, False

    def introduced(self, chars: list[int], links: list[int]) -> set[int]:
        """Lists and tables behind a heading or paragraph of their own container that isn't linked and doesn't name boilerplate, as a list of references."""
        names, parents = self.names, self.parents
        heads = {node: words for node, words, _ in self.blocks if names[node] in HEADINGS or names[node] == "p"}
        last: dict[int, int] = {}
        found = set()
        for node in range(1, len(names)):
            if not chars[node]:
                continue
            ahead = last.get(parents[node])
            if names[node] in ("ul", "ol", "dl", "table") and ahead in heads and 2 * links[ahead] < chars[ahead]:
                if names[ahead] == "p" or BOILERPLATE.isdisjoint(NAME_PART.findall(heads[ahead].lower())):
                    found.add(node)
            last[parents[node]] = node
        return found

    def main_blocks(self) -> list[str]:
        """Text of the blocks in the whole article around the best container and of worthy siblings, in page order."""
        names, parents = self.names, self.parents
        if not self.blocks:
            return []
        n = len(names)
        points, chars, links = [0.0] * n, [0] * n, [0] * n
        sentences = [0] * n
        for node, words, linked in self.blocks:
            chars[node] += len(words)
            links[node] += min(linked, len(words))
            if names[node] in ("li", "td", "th", "dd", "dt") or names[node] in HEADINGS:
                own = len(words) / 200
            else:
                own = (len(words) >= 25) + words.count(",") + min(len(words) / 100, 3.0)
            own *= 1 - min(linked, len(words)) / len(words)
            if names[node] in HEADINGS or names[node] in ("li", "td", "th", "dd", "dt") or SENTENCE_END.search(words):
                sentences[node] += len(words)
            # A block's text may stand right in a container, which is then its own first ancestor.
            up = node if names[node] in ("div", "article", "main", "section", "body", "td") else parents[node]
            for level in range(1, 6):
                if up < 0:
                    break
                points[up] += own / level
                up = parents[up]
        for node in range(n - 1, 0, -1):
            chars[parents[node]] += chars[node]
            links[parents[node]] += links[node]
            sentences[parents[node]] += sentences[node]
        left_out = {d for d in self.doubtful if links[d] > 0.5 * chars[d] or sentences[d] < SENTENCES * chars[d]}
        best, most = 0, -1.0
        total = [0.0] * n
        for node in range(n):
            if chars[node]:
                bonus = ARTICLE_BONUS if names[node] in ("article", "main") else 0.0
                total[node] = (points[node] + bonus) * (1 - links[node] / chars[node])
                if total[node] > most:
                    best, most = node, total[node]
        top, tagged = self.whole(best, chars, links)
        kept = {top}
        if parents[top] >= 0:
            limit = max(10.0, SIBLING_SHARE * most)
            for node in range(n):
                if parents[node] == parents[top] and node != top and chars[node]:
                    dense = links[node] / chars[node]
                    if total[node] >= limit or names[node] == "p" and dense < 0.25 and chars[node] >= 80:
                        kept.add(node)
        above, up = set(), best
        while up >= 0:
            above.add(up)
            up = parents[up]
        inside, scored, menu = [False] * n, [False] * n, [False] * n
        introduced = self.introduced(chars, links) if tagged else set()
        for node in range(n):
            up = parents[node]
            inside[node] = node in kept or up >= 0 and inside[up]
            scored[node] = node == best or up >= 0 and scored[up] or node in kept and node != top
            dense = chars[node] and links[node] > 0.67 * chars[node]
            # What is only taken along with the best container must be no row of links of other elements either.
            besides = not tagged and not scored[node] and node not in above and names[node] not in HEADINGS
            row = besides and links[node] and 2 * links[node] >= chars[node]
            menu[node] = node in left_out or up >= 0 and menu[up] or bool(dense) and names[node] in ("ul", "ol", "dl", "table") and node not in introduced or bool(row)
        return [words for node, words, _ in self.blocks if inside[node] and not menu[node]]


def main_text(html: str | None) -> str:
    """The main text of one page, blocks joined by an empty line; empty for null, empty or textless pages."""
    if not html:
        return ""
    # Where all text stands under names of boilerplate, only element names tell it from the article.
    blocks = Page().parse(html).main_blocks() or Page(by_class=False).parse(html).main_blocks()
    return "\n\n".join(blocks)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; one map over the table, no shuffle.

    Paragraphs pass points for length and commas to the containers above them, less with
    each level and with the share of linked text. All text of the article or main element
    around the best container is kept, without one all of the container that holds it and
    most unlinked text, menus left out, and siblings that come near. Null html gives an empty text. Repeated rows and null
    ids or urls are kept as they are; other columns are not read.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    source = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return map_arrow(source, rows, "page_id bigint, url string, text string, n_chars bigint", 500)
