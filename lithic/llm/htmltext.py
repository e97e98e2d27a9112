"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks (text between block-level tags). Each block has features
of its ancestors' tags and class words, its text and its place. The field has two labels,
article and other, is trained by gradient ascent on labelled pages, and is decoded by
Viterbi's algorithm. Labelled pages come from a seeded generator of six families of layouts,
in which every block's label is known; the operator takes any other labelled pages as well.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DIMENSIONS = 1 << 14

#: A tag whose attribute values hold no angle brackets: no part of the pattern gives back what it took, so it is linear.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"'=]++|=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=]++)?+)*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile("[a-z]+")
_LINK = re.compile(r"\bhref\b", re.I)

BLOCK = frozenset("html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend label address details summary dialog center menu hr option".split())
#: What they hold is never text of the page; each ends with its parent at the latest.
SILENT = frozenset("template svg object select button canvas audio video annotation annotation-xml".split())
#: Markup inside has no meaning up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCK - {"html", "body", "label", "legend", "option"}
#: Ancestors that a block's features look at, from the inside.
NEAREST = 64
#: Elements whose blocks are not a body of their own.
PARTS = frozenset("p li dt dd tr td th tbody thead tfoot h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption ul ol dl table caption summary label option legend".split())


@dataclass
class Block:
    text: str
    path: tuple  # (tag, class words) of the nearest block-level ancestors, outermost first
    linked: int  # characters inside links
    body: int = 0  # number of the innermost ancestor that is not a part of a text


class _Tags:
    """Tags of a page in one pass over it, whatever it holds."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        #: First occurrence of a character from some place on, kept because the place only grows.
        self.found: dict[str, int] = {}
        self.endless: set[str] = set()

    def next_of(self, what: str, at: int) -> int:
        known = self.found.get(what, -2)
        if known < at:
            known = self.page.find(what, at)
            known = self.found[what] = self.n if known < 0 else known
        return known

    def end(self, at: int) -> int:
        """Where the tag whose attributes begin at `at` ends, its `>` included.

        Quotes count only around values. A quote that is never closed, or whose value would run
        through other tags into the next attribute, is a slip: then the tag ends at the next `>`.
        """
        page = self.page
        while True:
            close, opened, equals = self.next_of(">", at), self.next_of("<", at), self.next_of("=", at)
            if equals >= min(close, opened):
                # An unquoted `<` begins the next tag.
                return min(close + 1, opened, self.n)
            at = equals + 1
            while at < self.n and page[at].isspace():
                at += 1
            if at < self.n and page[at] in "\"'":
                to, close = self.next_of(page[at], at + 1), self.next_of(">", at + 1)
                if to == self.n or close < to and page[to - 1] == "=" and self.next_of("<", close) < to:
                    return min(close + 1, self.n)
                at = to + 1

    def raw_end(self, tag: str, at: int) -> int | None:
        """The end of a raw element's own end tag; None if it has none."""
        if tag in self.endless:
            return None
        found = re.compile(f"</{tag}(?![a-z0-9-])[^>]*+(?:>|\\Z)", re.I).search(self.page, at)
        if not found:
            self.endless.add(tag)
            return None
        return found.end()


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space made single, empty ones left out.

    Elements whose start or end tags are left out, or that never end, cost no text: a head ends
    by itself, what is silent ends with its parent, and a raw element without an end is skipped
    as a tag (a script or style to the end of the page)."""
    out: list[Block] = []
    # Of each open element: tag, class words, whether it is silent, and its body's number.
    stack: list[tuple[str, tuple, bool, int]] = []
    opened: Counter = Counter()
    parts: list[str] = []
    linked = silent = bodies = 0
    inside = -1  # elements open where the link began that the text is in, or -1
    tags, at, n = _Tags(page), 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple([x[:2] for x in stack[-NEAREST:]]), linked, stack[-1][3] if stack else 0))
            parts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if not silent:
            piece = html.unescape(piece)
            parts.append(piece)
            if inside >= 0:
                linked += len(piece.strip())

    def pop_to(size: int) -> None:
        nonlocal silent, inside
        if size < inside:
            inside = -1
        for x in stack[size:]:
            opened[x[0]] -= 1
            silent -= x[2]
        del stack[size:]

    while at < n:
        start = page.find("<", at)
        if start != at:
            say(page[at : start if start >= 0 else n])
            if start < 0:
                break
            at = start
        m = _TAG.match(page, at)
        if m:
            closing, tag, attributes, at = bool(m[1]), m[2].lower(), m[3], m.end()
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        elif m := _NAME.match(page, at):
            closing, tag, begin = bool(m[1]), m[2].lower(), m.end()
            at = tags.end(begin)
            attributes = page[begin:at].rstrip(">")
        else:
            say("<")
            at += 1
            continue
        if tag in RAW:
            if not closing:
                end = tags.raw_end(tag, at)
                if end is not None:
                    at = end
                elif tag in ("script", "style") and not attributes.endswith("/"):
                    at = n
        elif tag in SILENT:
            if closing:
                if opened[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    pop_to(k)
            elif not attributes.endswith("/"):
                stack.append((tag, (), True, 0))
                opened[tag] += 1
                silent += 1
        elif tag == "br":
            say(" ")
        elif tag == "a":
            inside = -1 if closing or not _LINK.search(attributes) else len(stack)
        elif tag in BLOCK or "-" in tag:
            # Elements of a page's own are ancestors, but stand in a line of text like any unknown one.
            if tag in BLOCK and (not silent or closing and opened[tag]):
                flush()
            if closing:
                if opened[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    pop_to(k)
            else:
                if tag in ENDS_P and stack and stack[-1][0] == "p":
                    pop_to(len(stack) - 1)
                if tag not in VOID:
                    words = tuple(sorted({w for a in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower())} | set(_WORD.findall(tag) if "-" in tag else ()))) if attributes or "-" in tag else ()
                    if tag in PARTS and stack:
                        body = stack[-1][3]
                    else:
                        body = bodies = bodies + 1
                    stack.append((tag, words, False, body))
                    opened[tag] += 1
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (DIMENSIONS - 1)


#: Letters in a row of which class words are made up, so that unseen compounds of known words say something.
GRAM = 4


@lru_cache(maxsize=1 << 14)
def _path_slots(path: tuple) -> tuple:
    tags = ["own-element" if "-" in t else t for t, _ in path]
    found = {f"in {t}" for t in tags} | {f"of {w}" for _, words in path for w in words}
    found |= {f"like {w[k : k + GRAM]}" for _, words in path for w in words for k in range(max(1, len(w) - GRAM + 1))}
    if path:
        found.add(f"leaf {tags[-1]}")
        found |= {f"leaf of {w}" for w in path[-1][1]}
    if len(path) > 1:
        found.add(f"pair {tags[-2]} {tags[-1]}")
    return tuple(sorted({_slot(f) for f in found}))


def _looks(b: Block) -> tuple[int, int, bool]:
    share = b.linked / len(b.text)
    return min(8, (b.text.count(" ") + 1).bit_length()), 0 if not b.linked else 1 if share < 0.3 else 2 if share < 0.7 else 3, b.text[-1] in ".!?:;…。"


def features(found: list[Block]) -> list[tuple[tuple, list[int]]]:
    """Two parts of slots of each block's features: its ancestors, its text, its neighbours' texts, its place, and its body's share of unlinked text."""
    out = []
    last = len(found) - 1
    looks = [_looks(b) for b in found]
    mass: dict[int, int] = defaultdict(int)
    for b in found:
        mass[b.body] += len(b.text) - b.linked
    most = max(mass.values(), default=0)
    for k, b in enumerate(found):
        words, links, ends = looks[k]
        share = mass[b.body] / most if most else 0
        own = [
            f"words {words}",
            f"linked {links}",
            f"ends {ends}",
            f"words {words} linked {links} ends {ends}",
            f"place {'first' if k == 0 else 'last' if k == last else 'inside'}",
            f"body {4 if share == 1 else 3 if share > 0.5 else 2 if share > 0.2 else 1 if share > 0.05 else 0}",
            f"before {looks[k - 1][:2] if k else ''}",
            f"after {looks[k + 1][:2] if k < last else ''}",
            "always",
        ]
        if "©" in b.text:
            own.append("copyright")
        out.append((_path_slots(b.path), list(map(_slot, own))))
    return out


@dataclass(frozen=True)
class Field:
    """Scores: weights[label, feature] for blocks, moves[from, to] between neighbours."""

    weights: np.ndarray
    moves: np.ndarray

    def labels(self, feats: list[tuple[tuple, list[int]]]) -> list[int]:
        """The most probable label sequence."""
        if not feats:
            return []
        (w0, w1), ((a, b), (c, d)), paths = self._lists()
        s0, s1, back = 0.0, 0.0, []
        for k, (path, own) in enumerate(feats):
            known = paths.get(path)
            if known is None:
                if len(paths) > 1 << 14:
                    paths.clear()
                known = paths[path] = sum([w0[i] for i in path]), sum([w1[i] for i in path])
            e0, e1 = known[0] + sum([w0[i] for i in own]), known[1] + sum([w1[i] for i in own])
            if k:
                from0, from1 = s1 + c > s0 + a, s1 + d > s0 + b
                back.append((from0, from1))
                s0, s1 = (s1 + c if from0 else s0 + a), (s1 + d if from1 else s0 + b)
            s0, s1 = s0 + e0, s1 + e1
        out = [int(s1 > s0)]
        for from0, from1 in reversed(back):
            out.append(int(from1 if out[-1] else from0))
        return out[::-1]

    def _lists(self):
        kept = self.__dict__.get("_plain")
        if kept is None:
            # The last holds sums of paths, which recur on every page of a site.
            kept = (self.weights.tolist(), self.moves.tolist(), {})
            object.__setattr__(self, "_plain", kept)
        return kept


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(pages: list[tuple[list, list[int]]], steps: int = 60, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam; forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p[0]]
    n, t = len(pages), max(len(f) for f, _ in pages)
    y, size = np.zeros((n, t), np.int64), np.array([len(f) for f, _ in pages])
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
    slots = [np.array([*a, *b]) for f, _ in pages for a, b in f]
    flat, width = np.concatenate(slots), np.array([len(x) for x in slots])
    starts = np.cumsum(width) - width
    there = np.arange(t)[None] < size[:, None]
    w, moves = np.zeros((2, DIMENSIONS)), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(moves)]
    v = [np.zeros_like(w), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        e = np.zeros((n, t, 2))
        e[there] = np.stack([np.add.reduceat(w[k][flat], starts) for k in (0, 1)], axis=1)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = e[:, 0]
        for k in range(1, t):
            fwd[:, k] = np.where(there[:, k, None], _log_sum(fwd[:, k - 1, :, None] + moves, 1) + e[:, k], fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            bwd[:, k] = np.where(there[:, k + 1, None], _log_sum(moves + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], 2), 0)
        z = _log_sum(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * there[..., None]
        target = np.stack([(y == k) & there for k in (0, 1)], axis=2)
        gap = target - p
        gw = np.stack([np.bincount(flat, np.repeat(gap[there][:, k], width), DIMENSIONS) for k in (0, 1)])
        gm = np.zeros((2, 2))
        for k in range(1, t):
            live = there[:, k]
            pair = np.exp(fwd[live, k - 1, :, None] + moves + (e[live, k] + bwd[live, k])[:, None, :] - z[live, None, None])
            gm -= pair.sum(axis=0)
            np.add.at(gm, (y[live, k - 1], y[live, k]), 1)
        for j, (x, g) in enumerate(((w, gw / n - decay * w), (moves, gm / n - decay * moves))):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            x += rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    return Field(w, moves)


# --- labelled pages

_SYLLABLES = "an ber ca de en for ga hu is ja ka lo mi na or pa qui re sa ti un va wo xe yl zu".split()
_OTHER = {
    "nav": "nav ul.menu div.nav div#navigation div.breadcrumb div.menu div.topbar ul.pagination div.share div.social div.tags div.navbar ul.breadcrumbs div.pager div.toolbar nav.main-nav ul.nav-links div#sitemap div[role=navigation]".split(),
    "side": "aside div.sidebar div#sidebar div.widget section.related div.related aside.sidebar div.recommended section.newsletter div.author div.trending div.popular div.more-stories div.author-bio div[role=complementary]".split(),
    "foot": "footer div#footer div.footer div.copyright div.legal footer.site-footer div#colophon div.site-info div.credits div[role=contentinfo]".split(),
    "head": "header div#header div.header div.masthead div.banner header.site div.branding div#logo header.site-header div[role=banner]".split(),
    "note": "div.cookie-notice div.notice div.alert section.cookie div#cookies div[role=alert] div.popup div.warning div.subscribe div.paywall div.consent div#gdpr div.modal div.overlay div.toast".split(),
    "ad": "div.ad div.advert div.ads aside.promo div.sponsored div#ad-top div.advertisement section.ad ins.adsbygoogle div.promoted div.sponsor div.banner-ad div.affiliate".split(),
    "form": "form form.search div.login form#subscribe div.form div.signup div.search-box div#respond".split(),
    "talk": "section.comments div#comments div.comment ul.comments ol.commentlist div.replies div.discussion section#responses div.disqus_thread div.comment-section ul.comment-list div.user-comments div.feedback".split(),
}
_MAIN = "article main div.content div#content div.post article.post div.entry-content section.article div.article-body div#main main.content div section td div.story div.text div[role=main] div.blog-post".split()
#: What other names are made of.
_STEMS = {
    "nav": "nav menu navigation links breadcrumb pager", "side": "sidebar aside related widget trending", "foot": "footer bottom copyright legal", "head": "header masthead top banner",
    "note": "cookie notice consent alert popup", "ad": "ad ads advert sponsor promo", "form": "form search login signup", "talk": "comments comment replies discussion disqus thread",
    "main": "article story post content body text entry",
}
#: Layouts: known names; none; paragraphs right in the body; elements of the page's own; unknown compounds; many wrappers.
FAMILIES = ("known", "bare", "direct", "custom", "compound", "nested")


def _spec(r: random.Random, kind: str, family: str) -> str:
    """Element, and class, id or role, of a part of a page."""
    stem, other = r.choice(_STEMS[kind].split()), "".join(r.choices(_SYLLABLES, k=2))
    if family == "bare":
        return r.choice(["div", "div", "td", "section"] if kind == "main" else ["div", "ul", "td"])
    if family == "direct" and kind == "main":
        return r.choice(["", "", "center"])
    if family == "custom":
        return r.choice([f"{other}-{stem}", f"{stem}-{other}", f"app-{stem}", f"x-{stem}", f"{other}-{stem}-{r.choice(['box', 'list', 'area'])}"] if kind != "main" or r.random() < 0.7 else [f"{other}-{other}"])
    if family == "compound" and (kind != "main" or r.random() < 0.6):
        return f"{r.choice(['div', 'section', 'div', 'ul'])}{r.choice('.#')}{r.choice([f'{other}-{stem}', f'{stem}-{other}', f'{other}{stem}', f'{stem}_{other}', f'{stem}s-{other} {other}'])}"
    if family == "compound":
        return f"div.{other}"
    return r.choice(_MAIN if kind == "main" else _OTHER[kind])


def _phrase(r: random.Random, low: int, high: int, stop: bool = True) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + ("." if stop and r.random() < 0.9 else "")


def _open(spec: str) -> tuple[str, str]:
    if not spec:
        return "", ""
    tag = re.match("[a-z0-9-]+", spec)[0]
    rest = spec[len(tag) :]
    attribute = {"": "", ".": f' class="{rest[1:]}"', "#": f' id="{rest[1:]}"', "[": f" {rest[1:-1]}"}[rest[:1]]
    return f"<{tag}{attribute}>", f"</{tag}>"


def labelled_page(seed: int, family: str = "known") -> tuple[str, list[tuple[str, int]]]:
    """A page of random layout, and its blocks' texts with label 1 for the article's."""
    r = random.Random(seed)
    out: list[str] = []
    truth: list[tuple[str, int]] = []

    def put(text: str, label: int) -> str:
        truth.append((" ".join(text.split()), label))
        return html.escape(text)

    def other(kind: str) -> None:
        if family == "bare" and kind in ("talk", "note", "ad"):
            return  # nothing tells them from an article there
        a, z = _open(_spec(r, kind, family))
        out.append(a)
        listed = kind == "nav" or kind in ("side", "foot", "head") and (r.random() < 0.5 or family == "bare")
        for _ in range(r.randint(1, 7) if listed else r.randint(1, 3)):
            if listed:
                tag = "li" if r.random() < 0.8 else "p"
                out.append(f'<{tag}><a href="/x">{put(_phrase(r, 1, 4, False), 0)}</a></{tag}>')
            elif kind == "talk":
                out.append(f"<p>{put(_phrase(r, 3, 60), 0)}</p>")
            elif kind == "form":
                out.append(f"<label>{put(_phrase(r, 1, 4, False), 0)}</label><input type=text>")
            else:
                text = put(("© " if kind == "foot" and r.random() < 0.7 else "") + _phrase(r, 2, 25), 0)
                out.append(text + "<hr>" if r.random() < 0.3 and family != "custom" else f"<p>{text}</p>")
        out.append(z)

    def linked(text: str) -> str:
        """`text`, some of its words a link."""
        words = text.split(" ")
        k = r.randrange(len(words))
        return " ".join([*words[:k], f'<a href="/y">{words[k]}</a>', *words[k + 1 :]])

    def article() -> None:
        wraps = [_open(r.choice(["div.wrap", "div.container", "div.row", "div", "div#page", "main", "section", "div.col"])) for _ in range(r.randint(1, 5) if family == "nested" else 0)]
        a, z = _open(_spec(r, "main", family))
        out.append("".join(w[0] for w in wraps) + a)
        if r.random() < 0.85:
            out.append(f"<h1>{put(_phrase(r, 2, 14, False), 1)}</h1>")
        # Some articles are lists of links; only a name or the lack of anything else tells them from a menu.
        of_links = plain or family in ("known", "nested") and r.random() < 0.1
        for _ in range(r.choice([1, 1, 2, 4, 8, 16])):
            shape = 0.28 if of_links and r.random() < 0.5 else r.random()
            if shape < 0.08:
                out.append(f"<h2>{put(_phrase(r, 1, 8, False), 1)}</h2>")
            elif shape < 0.16:
                out.append("<ul>" + "".join(f"<li>{put(_phrase(r, 1, 20, False), 1)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif shape < 0.2:
                out.append(f"<blockquote><p>{put(_phrase(r, 4, 30), 1)}</p></blockquote>")
            elif shape < 0.23:
                out.append(f"<pre>{put(_phrase(r, 1, 30), 1)}</pre>")
            elif shape < 0.26:
                out.append("<table><tr>" + "".join(f"<td>{put(_phrase(r, 1, 5, False), 1)}</td>" for _ in range(r.randint(2, 4))) + "</tr></table>")
            elif shape < 0.3 and (plain or family in ("known", "nested", "custom")):
                out.append("".join(f'<p><a href="/z">{put(_phrase(r, 2, 12, False), 1)}</a></p>' for _ in range(r.randint(1, 2))))
            elif shape < 0.35 and len(truth) > 3 and family != "direct" and not plain:
                other(r.choice(["ad", "note", "nav", "side"]))
            else:
                text = put(_phrase(r, r.choice([1, 2, 6, 12]), r.choice([12, 40, 120])), 1)
                out.append(f"<p>{linked(text) if r.random() < 0.2 else text}" + ("</p>" if r.random() < 0.8 else ""))
        if r.random() < 0.25 and family != "direct" and not plain:
            other("talk")
        out.append(z + "".join(w[1] for w in reversed(wraps)))

    head = f"<title>{_phrase(r, 2, 8)}</title><style>p{{}}</style><script>var a='</p>';</script>"
    out.append(f"<!DOCTYPE html><html><head>{head}</head><body>" if r.random() < 0.9 else head)
    plain = r.random() < 0.12  # an article and nothing else
    for kind, chance in () if plain else (("note", 0.3), ("head", 0.5), ("nav", 0.7), ("ad", 0.5), ("form", 0.25)):
        if r.random() < chance:
            other(kind)
    article()
    if plain:
        out.append("</body></html>")
        return "".join(out), truth
    for kind, chance in (("talk", 0.35), ("side", 0.5), ("ad", 0.3), ("form", 0.2), ("nav", 0.2), ("note", 0.15), ("foot", 0.8)):
        if r.random() < chance:
            other(kind)
    out.append("</body></html>")
    return "".join(out), truth


def generated_pages(count: int, first: int = 0, families: tuple = FAMILIES) -> list[tuple[list, list[int]]]:
    """Pages of the families in turn, as features and labels."""
    pages = []
    for seed in range(first, first + count):
        page, truth = labelled_page(seed, families[seed % len(families)])
        found = blocks(page)
        if [b.text for b in found] != [t for t, _ in truth]:
            raise AssertionError(f"layout {seed}: blocks differ from those written")
        pages.append((features(found), [label for _, label in truth]))
    return pages


#: Pages that the standard field is trained on.
TRAINING_PAGES = 1200

_standard: list[Field] = []


def standard_field() -> Field:
    if not _standard:
        _standard.append(train(generated_pages(TRAINING_PAGES)))
    return _standard[0]


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, field.labels(features(found))) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row, without any exchange.

    Null or empty html, and pages without an article, have the empty text. Pages are read whole,
    in time that grows with their length only. Rows that repeat are extracted each; null ids and
    addresses stay null. Of two equally probable labellings the one with less article is taken.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or standard_field())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [main_text(x, shared.value) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
