"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, table

# Element classes of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
# An open element that a start tag closes, and the elements at which the search stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPE = set("html body article aside section nav header footer main div td th table form blockquote figure details".split())
HEAD = set("base link meta noscript script style template title".split())  # what does not end the head
UNSEEN = set("head noscript script style template title".split())  # never shown
FURTHER, LONE = 10, 3  # a further region has at least a tenth of the densest one's sum, a lone line a third
# What is not part of an article, by tag, role and word of class or id.
NOISE_TAGS = set("nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input menu dialog head title search".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NOISE_WORDS = set(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner sidebar menu navbar navigation nav breadcrumb breadcrumbs crumbs "
    "footer masthead topbar cookie cookies consent gdpr notice notices notification announcement alert toast popup modal overlay lightbox newsletter subscribe "
    "signup login search share sharing social related recommended teaser outbrain taboola pagination pager toolbar widget skip".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus replies respond discussion feedback".split())
# First tokens of a name that states what its element has, and last tokens after which the first says what it is.
STATES = set("has with without no not is show hide".split())
HOLDERS = set("area block body box button buttons container content group inner item items left link links list outer region right section text top bottom wrap wrapper".split())
ATTRS = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def _name_words(value: str) -> set[str]:
    """What the names of a class or id say: whole names and their last tokens,
    before a holder the first too; not what a name says its element has."""
    out = set()
    for name in value.split():
        tokens = [t for t in re.split(r"[^a-z0-9]+", name) if t]
        while len(tokens) > 1 and tokens[-1][0].isdigit():
            tokens.pop()
        if not tokens or tokens[0] in STATES:
            continue
        out |= {name, tokens[-1]}
        if tokens[-1] in HOLDERS:
            out.add(tokens[0])
    return out


class Dom:
    """Elements in page order as parallel lists, and the text between them."""

    def __init__(self, source: str):
        self.tag: list[str] = ["body"]
        self.parent: list[int] = [-1]
        self.noise: list[int] = [0]  # 1: not if it holds the article, 2: in any case, 3: if outside the article
        self.named: list[bool] = [False]  # noise by class or id only
        self.unseen: list[bool] = [False]
        self.events: list[tuple[int, str | None]] = []  # (element, text), None: a block border
        self._parse(source)

    def _open(self, stack: list[int], name: str, attrs: str) -> None:
        if name != "html" and name not in HEAD and len(stack) > 1 and self.tag[stack[1]] == "head":
            self._close(stack, {"head"}, set())
        if name in ("html", "body"):
            return
        if name in BLOCK:
            self._close(stack, {"p"}, SCOPE)
        if name in CLOSES:
            self._close(stack, *CLOSES[name])
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(stack[-1])
        hidden = bool(attrs.strip()) and self._hidden(attrs)
        found, named = (1, False) if hidden else self._is_noise(name, attrs)
        self.noise.append(found)
        self.named.append(named)
        self.unseen.append(name in UNSEEN or hidden)
        if name in BLOCK:
            self.events.append((node, None))
        if name == "br":
            self.events.append((stack[-1], " "))
        if name not in VOID:
            stack.append(node)

    def _close(self, stack: list[int], names: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[k]]
            if name in names:
                for node in stack[k:]:
                    if self.tag[node] in BLOCK:
                        self.events.append((node, None))
                del stack[k:]
                return
            if name in scope:
                return

    @staticmethod
    def _hidden(attrs: str) -> bool:
        for key, *values in ATTRS.findall(attrs):
            key, value = key.lower(), "".join(values).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    def _is_noise(self, name: str, attrs: str) -> tuple[int, bool]:
        if name in NOISE_TAGS:
            return 1, False
        found, by_name = 3 if name == "header" else 0, 0
        if not attrs.strip():
            return found, False
        for key, *values in ATTRS.findall(attrs):
            key, value = key.lower(), "".join(values).lower()
            if key in ("class", "id"):
                if name in ("article", "main"):
                    by_name = 2 if set(value.split()) & COMMENT_WORDS else by_name
                    continue
                words = _name_words(value)
                if words & COMMENT_WORDS:
                    by_name = 2
                elif words & NOISE_WORDS:
                    by_name = by_name if by_name == 2 else 1
                elif "header" in words:
                    by_name = by_name or 3
            elif key == "role" and value in NOISE_ROLES:
                return 1, False
        if found == 3:  # a header element stays one whatever its names
            return by_name if by_name in (1, 2) else 3, False
        return by_name, by_name > 0

    def _parse(self, s: str) -> None:
        stack, at, n = [0], 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0 or lt + 1 >= n:
                self.events.append((stack[-1], html.unescape(s[at:])))
                break
            if lt > at:
                self.events.append((stack[-1], html.unescape(s[at:lt])))
            c = s[lt + 1]
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif c in "!?" or c == "/" and not s[lt + 2 : lt + 3].isalpha():
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
            elif c == "/":
                name = NAME.match(s, lt + 2).group().lower()
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
                if name not in ("html", "body"):
                    inner = name in ("p", "li", "dt", "dd") or name not in BLOCK
                    self._close(stack, {name}, SCOPE - {name} if inner else set())
            elif c.isascii() and c.isalpha():
                name = NAME.match(s, lt + 1).group()
                begin = lt + 1 + len(name)
                m = TAG_END.match(s, begin)
                end = m.end() if m else s.find(">", begin) + 1 or n
                at, name = end, name.lower()
                self._open(stack, name, s[begin : end - 1])
                if name in RAW:
                    m = RAW_END[name].search(s, at)
                    at = m.start() if m else n  # what stands inside is no text of the page
            else:
                self.events.append((stack[-1], "<"))
                at = lt + 1


def _sums(dom: Dom, keep: list[bool]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Characters, tags, link characters, link tags below each element; own characters."""
    n = len(dom.tag)
    own, chars, tags, lchars, ltags = ([0] * n for _ in range(5))
    link = [False] * n
    for k in range(1, n):
        link[k] = dom.tag[k] == "a" or link[dom.parent[k]]
    for node, text in dom.events:
        if text and keep[node]:
            size = sum(map(len, text.split()))
            own[node] += size
            lchars[node] += size if link[node] else 0
    for k in range(n - 1, -1, -1):
        chars[k] += own[k]
        if k and keep[k]:
            p = dom.parent[k]
            chars[p] += chars[k]
            lchars[p] += lchars[k]
            tags[p] += tags[k] + 1
            ltags[p] += ltags[k] + (dom.tag[k] == "a")
    return chars, tags, lchars, ltags, own


def _density(c: int, t: int, lc: int, lt: int, link_share: float) -> float:
    """Characters per tag, lowered where links hold them."""
    if not c:
        return 0.0
    t = max(t, 1)
    base = math.log(c / max(c - lc, 1) * lc + link_share * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(max(base, 1 + 1e-6))


def _headings(dom: Dom, keep: list[bool], chars: list[int]) -> list[int]:
    """Headings with text in each element."""
    below = [int(keep[k] and t in ("h1", "h2") and chars[k] > 0) for k, t in enumerate(dom.tag)]
    for k in range(len(below) - 1, 0, -1):
        below[dom.parent[k]] += below[k]
    return below


def _whole_article(dom: Dom, node: int, below: list[int], chars: list[int], lchars: list[int]) -> int:
    """The enclosing article, else the element widened as long as that adds a
    heading and at most half as much text, few of it links."""
    up = node
    while up:
        if dom.tag[up] in ("article", "main"):
            return up
        up = dom.parent[up]
    best, up = node, node
    while up:
        up = dom.parent[up]
        more = chars[up] - chars[best]
        if below[up] > below[best] and 2 * more <= chars[best] and 3 * (lchars[up] - lchars[best]) <= more:
            best = up
    return best


def _spared(dom: Dom) -> list[bool]:
    """Elements that only their name calls noise but that hold most of the page's
    text outside links, whatever lies in further elements named so left aside;
    of a name for comments, twice as much as is found outside of comments.  On
    pages with an article element that is asked only inside of it, and not of
    comments."""
    n = len(dom.tag)
    owner, hard, link, said, held = list(range(n)), [False] * n, [False] * n, [False] * n, [0] * n
    for k in range(1, n):
        p = dom.parent[k]
        hard[k] = hard[p] or dom.noise[k] == 1 and not dom.named[k]
        link[k] = link[p] or dom.tag[k] == "a"
        owner[k] = k if dom.named[k] else owner[p]
        said[k] = said[p] or dom.noise[k] == 2
    for node, text in dom.events:
        if text and not hard[node] and not link[node]:
            held[owner[node]] += sum(map(len, text.split()))
    total = sum(h for k, h in enumerate(held) if dom.noise[k] != 2)
    article = [t in ("article", "main") and not said[k] for k, t in enumerate(dom.tag)]
    within = list(article)
    for k in range(1, n):
        within[k] |= within[dom.parent[k]]
    # where the page says what its article is, only parts of that are in doubt
    open_ = [dom.named[k] and (within[k] or not any(article)) for k in range(n)]
    spared = [dom.noise[k] == 2 and open_[k] and not any(article) and held[k] > 2 * total for k in range(n)]
    total += sum(h for h, s in zip(held, spared) if s)
    spared = [s or open_[k] and dom.noise[k] != 2 and 2 * held[k] > total for k, s in enumerate(spared)]
    inside = list(spared)
    for k in range(n - 1, 0, -1):
        inside[dom.parent[k]] |= inside[k]
    return [dom.named[k] and inside[k] for k in range(n)]


def _regions(dom: Dom, seen: list[bool], share: float, widen: tuple[list[int], list[int], list[int]], further: int, lone: int) -> tuple[list[bool], int]:
    """Roots of the regions that density picks among the elements ``seen``, and
    the element of the largest sum.

    The threshold is the least density on that element's path to the body,
    without the body: that holds the page's other parts too.  From the body
    down, every topmost element as dense as that gives its subtree of the
    largest sum.  Further subtrees need one ``further``-th of the page's largest
    sum, or one ``lone``-th where one element holds all their text (0: any will
    do): a lone line without links is denser than any article.
    """
    n = len(dom.tag)
    article = [t in ("article", "main") for t in dom.tag]
    chars, tags, lchars, ltags, own = _sums(dom, seen)
    density = [_density(chars[k], tags[k], lchars[k], ltags[k], share) if seen[k] else 0.0 for k in range(n)]
    total = [_density(own[k], 1, 0, 0, share) if own[k] else 0.0 for k in range(n)]
    for k in range(1, n):
        total[dom.parent[k]] += density[k]
    best = max(range(n), key=lambda k: (total[k], -k))
    path = [best]
    while dom.parent[path[-1]] > 0:
        path.append(dom.parent[path[-1]])
    # without a link the density only grows with the element: characters per tag decide
    reach = density if lchars[0] else [chars[k] / max(tags[k], 1) if seen[k] else 0.0 for k in range(n)]
    threshold = min(reach[k] for k in path)
    roots, done, top = [False] * n, [False] * n, [False] * n
    peak, holders = list(range(n)), [int(x > 0) for x in own]
    for k in range(n - 1, 0, -1):
        p = dom.parent[k]
        if (total[peak[k]], -peak[k]) > (total[peak[p]], -peak[p]):
            peak[p] = peak[k]
        holders[p] += holders[k]
    marked = False
    for k in range(n):
        p = dom.parent[k]
        done[k] = roots[k] or k > 0 and done[p]
        top[k] = not k or top[p] and seen[k] and chars[k] > 0 and reach[k] >= threshold
        need = further if holders[peak[k]] > 1 else lone
        if top[k] and not done[k] and (not need or need * total[peak[k]] >= total[best]):
            whole = _whole_article(dom, peak[k], *widen)
            marked = marked or not k and article[whole]
            # where the densest is an article, others are looked for in articles only
            roots[whole] = roots[whole] or not marked or article[whole]
            done[k] = roots[k]
    return roots, best


def main_text(source: str | None, further: int = 0, lone: int = 0) -> str:
    """Main text of a page: blocks in page order, one per line; "" if none.

    Density picks the regions among all that the page shows; what tags, roles
    and names call furniture goes from inside them.  Where that is most of the
    densest element, the element is furniture itself, and density picks again
    without what is called so.  ``further`` and ``lone``: what small regions
    need beside the densest one, see ``_regions``; by default nothing.
    """
    if not source:
        return ""
    dom = Dom(source)
    n = len(dom.tag)
    dom.noise = [0 if s else x for s, x in zip(_spared(dom), dom.noise)]
    article = [t in ("article", "main") for t in dom.tag]
    out, within, keep, seen = [False] * n, [False] * n, [True] * n, [True] * n
    for k in range(1, n):
        p = dom.parent[k]
        out[k] = out[p] or dom.noise[k] == 2
        within[k] = within[p] or article[p]
    holds = [a and not o for a, o in zip(article, out)]
    for k in range(n - 1, 0, -1):
        holds[dom.parent[k]] |= holds[k]
    for k in range(1, n):
        p = dom.parent[k]
        noise = dom.noise[k] == 1 or dom.noise[k] == 3 and not within[k]
        seen[k] = seen[p] and not (dom.unseen[k] and not holds[k])
        keep[k] = keep[p] and seen[k] and not out[k] and not (noise and not holds[k])
    chars, _, lchars, _, _ = _sums(dom, [True] * n)
    share = lchars[0] / max(chars[0], 1)
    shown = _sums(dom, seen)[0]
    kept, _, lkept, _, _ = _sums(dom, keep)
    widen = (_headings(dom, keep, kept), kept, lkept)
    chosen, best = _regions(dom, seen, share, widen, further, lone)
    if 2 * kept[best] < shown[best]:
        chosen, _ = _regions(dom, keep, share, widen, further, lone)
    for k in range(1, n):
        chosen[k] = (chosen[k] or chosen[dom.parent[k]]) and keep[k]
    blocks, run = [], []
    for node, text in dom.events:
        if text is None:
            blocks.append("".join(run))
            run = []
        elif chosen[node]:
            run.append(text)
        elif keep[node]:  # text between two regions parts them
            run.append(" ")
    blocks.append("".join(run))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", further: int = FURTHER, lone: int = LONE) -> DataFrame:
    """``(id, url, text)`` per row of ``pages``; ``text`` is the main text.

    Regions beside the densest one need a tenth of its density sum, lone lines a
    third (``further``, ``lone``; 0: any will do).

    A null page is empty and has the text ""; broken markup is read as
    browsers mostly do; repeated rows and null ids stay; an empty table gives
    no rows; other columns are not read.  No shuffle; time and memory are
    linear in the page but for the depth of unclosed elements.
    """
    session(pages)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py(), further, lone) for x in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], ["id", "url", "text"])

    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(scan, schema).withColumnsRenamed({"id": id_col, "url": url_col})


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

