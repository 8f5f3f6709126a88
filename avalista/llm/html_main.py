"""Main text of web pages, by a recurrent labeller of text blocks.

A page is read as a sequence of leaf blocks: runs of text between block-level tags, with the path of tags, classes and ids
above them. A bidirectional LSTM in numpy reads, block by block, the hashed path, the mean of the hashed words' vectors and a few
sizes, and labels every block as main text or not with the whole page as context; blocks of one parent element share
their mean logit. The main text is the blocks so labelled, in page order.

The labeller is trained here, on a bounded sample of pages (``Settings.pages``, each at most ``page_chars`` long, drawn by hash of the html, equal pages once). Pages that
mark their article themselves (``article`` or ``main``) teach which blocks are main text; each is also re-dressed: its own blocks are
dealt into layouts with other tags, class names and additional menus, notices, side bars, forms, adverts and reader comments, sometimes with names that tell
nothing, so the labeller does not rest on one template.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space. Scripts, styles, titles,
form controls, comments and markup are never text. Broken markup is read as far as it goes; unclosed elements end with their parent, and of an
unclosed button, object or the like only the text up to the next tag is left out. Of more than ``2 * FAR`` nested elements, the innermost and outermost ``FAR`` make the path. A null or
blank html gives an empty text; rows are independent, so repeated rows and null ids are returned as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[A-Za-z]+")
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style template noscript title textarea select svg iframe object canvas audio video math button".split())
RAW = frozenset("script style textarea title".split())  # without an end tag they run to the end of the page
FAR = 32  # so many outermost and innermost elements make a path
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}


@dataclass
class Block:
    path: tuple[str, ...]  # tokens of the elements above, outermost first, "/" before each element
    text: str
    linked: float  # share of the text in links
    parent: int  # number of the element that holds the block's own element


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    names = ["/" + tag]
    if attributes and not attributes.isspace():
        for key, value in ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("hidden", "aria-hidden"):
                names.append("@" + key)
            for part in NAME_PART.findall(value.lower()):
                names.append(("#" if key == "id" else ".") + part)
    return tuple(names)


def _tag_end(page: str, at: int, dead: bytearray) -> int:
    """Where the tag whose name ends at ``at`` ends: at the first ``>`` outside of quotes, else at the first one, else -1.

    ``dead`` marks the places from which, outside of quotes, no such ``>`` follows; as no scan enters one twice, all scans of a page together are linear.
    """
    place, seen = at, []
    while True:
        quote = -1
        if not dead[place]:
            found = STOP.search(page, place)
            if found is not None and found[0] == ">":
                return found.start()
            seen.append((place, found.start() if found else len(page)))
            quote = page.find(found[0], found.end()) if found else -1
        if quote < 0:
            for start, end in seen:
                dead[start : end + 1] = b"\1" * (end + 1 - start)
            return page.find(">", at)
        place = quote + 1


def _tokens(page: str):
    """(start, end, closing, tag, attributes) of the tags of a page, and of comments and declarations with a tag of None."""
    at, last, dead = 0, page.rfind(">"), bytearray(len(page) + 2)
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, None, ""
        elif at > last:  # no tag ends from here on
            at = page.find("<!--", at)
            if at < 0:
                return
            continue
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, False, None, ""
        elif (m := TAG.match(page, at)) and (close := _tag_end(page, m.end(), dead)) >= 0:
            end = close + 1
            skip = yield at, end, bool(m[1]), m[2].lower(), page[m.end() : close]
            if skip:
                end = skip
                yield
        else:
            end = at + 1
        at = end


def read_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in time linear in its length."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = [("", (), 0)]  # tag, names, number
    opened: Counter[str] = Counter()  # elements of the stack by tag
    ends: dict[str, int] = {}  # the last end tag of skipped elements
    made, links, held, in_link = 0, 0, [], 0

    def flush():
        nonlocal held, in_link
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                above = stack if len(stack) <= 2 * FAR else stack[:FAR] + stack[-FAR:]
                path = tuple(n for _, names, _ in above for n in names)
                parent = stack[-2][2] if len(stack) > 1 else 0
                blocks.append(Block(path, text, min(1.0, in_link / max(1, len(text))), parent))
        held, in_link = [], 0

    def leave(upto: int):
        opened.subtract(tag for tag, _, _ in stack[upto:])
        del stack[upto:]

    def innermost(tag: str, stop=()) -> int:
        """The place of the innermost open element of a tag, 0 if there is none before an element of ``stop``."""
        if opened[tag] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    return i
                if stack[i][0] in stop:
                    break
        return 0

    at, tokens = 0, _tokens(page)
    for start, end, closing, tag, attributes in tokens:
        if start > at:
            piece = page[at:start]
            held.append(piece)
            if links:
                in_link += len(piece.strip())
        at = end
        if tag is None:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            held.append(" ")
            continue
        if closing:
            flush()
            if tag in ("html", "body"):
                continue
            if i := innermost(tag):
                leave(i)
            links = 0
            continue
        if tag in SKIPPED:
            if not attributes.endswith("/"):
                over = re.compile(rf"</{tag}(?:\s[^>]*)?>", re.I)
                if tag not in ends:
                    ends[tag] = max((m.start() for m in over.finditer(page, at)), default=-1)
                if ends[tag] >= at:
                    at = over.search(page, at).end()
                elif tag in RAW:
                    at = len(page)
                else:  # never closed: its own text, up to the next tag
                    at = found if (found := page.find("<", at)) >= 0 else len(page)
                if at > end:
                    tokens.send(at)
            held.append(" ")
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[-1][0] == "p":
            leave(len(stack) - 1)
        elif tag in SAME:
            if i := innermost(tag, SAME[tag]):
                leave(i)
        made += 1
        stack.append((tag, _names(tag, attributes), made))
        opened[tag] += 1
    held.append(page[at:])
    flush()
    return blocks


@dataclass(frozen=True)
class Settings:
    pages: int = 300  # bound on the sample
    page_chars: int = 40_000  # longest page in the sample
    dressed: int = 5  # layouts made of each page
    path_buckets: int = 1 << 12
    word_buckets: int = 1 << 12
    path_dim: int = 20
    word_dim: int = 8
    hidden: int = 20
    epochs: int = 5
    batch: int = 24
    rate: float = 0.01
    seed: int = 5


SIZES = 6


class Features:
    """Hashed inputs of blocks; words and paths that were hashed before are looked up."""

    def __init__(self, settings: Settings):
        self.s, self.words, self.paths = settings, {}, {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            elements = [i for i, n in enumerate(path) if n[0] == "/"]
            names, near = list(dict.fromkeys(path)), path[elements[-2] :] if len(elements) > 1 else path
            names += ["own" + n for n in dict.fromkeys(near)]
            found = self.paths[path] = np.array([zlib.crc32(n.encode()) % self.s.path_buckets for n in names] or [0])
        return found

    def word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > 300_000:
                self.words.clear()
            found = self.words[word] = zlib.crc32(word.lower().encode()) % self.s.word_buckets
        return found

    def sizes(self, block: Block, i: int, n: int, n_words: int) -> list[float]:
        t = block.text
        return [min(len(t), 3000) ** 0.25 / 4, block.linked, sum(map(t.count, ".,;:!?")) / max(1, n_words), i / max(1, n - 1), min(1.0, 3 / (n + 1)), t[-1] in ".!?"]

    def page(self, blocks: list[Block]):
        """Path buckets per block, word buckets per block, sizes."""
        words = [np.array([self.word(w) for w in b.text.split()]) for b in blocks]
        return [self.path(b.path) for b in blocks], words, np.array([self.sizes(b, i, len(blocks), len(w)) for i, (b, w) in enumerate(zip(blocks, words))], np.float32)


def _means(table: np.ndarray, rows: list[np.ndarray], root: bool) -> np.ndarray:
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    sums = np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
    return sums / (np.sqrt(sizes) if root else sizes)[:, None]


def init(settings: Settings) -> dict[str, np.ndarray]:
    rng, s = np.random.default_rng(settings.seed), settings
    d, h = s.path_dim + s.word_dim + SIZES, s.hidden
    out = {"path": rng.normal(0, 0.3, (s.path_buckets, s.path_dim)), "word": rng.normal(0, 0.1, (s.word_buckets, s.word_dim))}
    for way in "fb":
        out[f"wx{way}"] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * h))
        out[f"wh{way}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        out[f"b{way}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
    out["out"], out["skip"], out["base"] = rng.normal(0, 0.3, 2 * h), rng.normal(0, 0.1, d), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in out.items()}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: dict, way: str, keep: bool = False):
    """One direction over time x pages x inputs; padded places carry the state on. Returns the states, and what training needs."""
    steps, pages, _ = x.shape
    hidden = w["wh" + way].shape[0]
    gates_in = x @ w["wx" + way] + w["b" + way]
    h, c = np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32)
    out, tape = np.zeros((steps, pages, hidden), np.float32), []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        g = gates_in[t] + h @ w["wh" + way]
        i, f, o = (_sigmoid(g[:, k * hidden : (k + 1) * hidden]) for k in range(3))
        u = np.tanh(g[:, 3 * hidden :])
        m = mask[t][:, None]
        c_new = np.where(m, f * c + i * u, c)
        tc = np.tanh(c_new)
        h_new = np.where(m, o * tc, h)
        if keep:
            tape.append((t, h, c, i, f, o, u, tc))
        h, c = h_new, c_new
        out[t] = h
    return out, tape


def _back(x, mask, w, way, tape, dout, grads):
    hidden = w["wh" + way].shape[0]
    dx = np.zeros_like(x)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t, h0, c0, i, f, o, u, tc in reversed(tape):
        m = mask[t][:, None]
        dh = dh + dout[t]
        dht, dhp = np.where(m, dh, 0), np.where(m, 0, dh)
        dct = np.where(m, dc + dht * o * (1 - tc * tc), 0)
        dg = np.concatenate([dct * u * i * (1 - i), dct * c0 * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - u * u)], 1)
        grads["wx" + way] += x[t].T @ dg
        grads["wh" + way] += h0.T @ dg
        grads["b" + way] += dg.sum(0)
        dx[t] = dg @ w["wx" + way].T
        dh = dhp + dg @ w["wh" + way].T
        dc = np.where(m, dct * f, dc)
    return dx


def _pad(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in inputs)
    x, mask = np.zeros((steps, len(inputs), inputs[0].shape[1]), np.float32), np.zeros((steps, len(inputs)), bool)
    for p, rows in enumerate(inputs):
        x[: len(rows), p], mask[: len(rows), p] = rows, True
    return x, mask


def logits(pages: list[list[Block]], weights: dict, features: Features) -> list[np.ndarray]:
    """A logit per block. Pages of similar length run together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        take = 1
        while at + take < len(order) and take < 128 and len(pages[order[at + take]]) * (take + 1) <= 20_000:
            take += 1
        some = order[at : at + take]
        at += take
        inputs = []
        for i in some:
            paths, words, sizes = features.page(pages[i])
            inputs.append(np.concatenate([_means(weights["path"], paths, True), _means(weights["word"], words, False), sizes], 1).astype(np.float32))
        x, mask = _pad(inputs)
        both = np.concatenate([_run(x, mask, weights, way)[0] for way in "fb"], 2)
        z = both @ weights["out"] + x @ weights["skip"] + weights["base"][0]
        for p, i in enumerate(some):
            out[i] = z[: len(pages[i]), p]
    return out


def label(blocks: list[Block], z: np.ndarray) -> np.ndarray:
    """Whether each block is main text: its logit and the mean logit of the blocks with the same parent, together."""
    parents = np.array([b.parent for b in blocks])
    _, group = np.unique(parents, return_inverse=True)
    mean = np.bincount(group, z) / np.bincount(group)
    return 0.35 * z + 0.65 * mean[group] > 0


def train(pages: list[tuple[list[Block], np.ndarray]], settings: Settings = Settings()) -> dict[str, np.ndarray]:
    """Weights fitted to pages and their block labels, by Adam on the logistic loss."""
    s, rng, w = settings, np.random.default_rng(settings.seed), init(settings)
    features = Features(s)
    data = [(*features.page(blocks), y.astype(np.float32)) for blocks, y in pages if blocks]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    steps = max(1, s.epochs * ((len(data) + s.batch - 1) // s.batch))
    for _ in range(s.epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), s.batch):
            some = [data[i] for i in order[at : at + s.batch]]
            inputs = [np.concatenate([_means(w["path"], p, True), _means(w["word"], v, False), z], 1).astype(np.float32) for p, v, z, _ in some]
            x, mask = _pad(inputs)
            y = np.zeros(mask.shape, np.float32)
            for p, row in enumerate(some):
                y[: len(row[3]), p] = row[3]
            (hf, tf), (hb, tb) = _run(x, mask, w, "f", True), _run(x, mask, w, "b", True)
            both = np.concatenate([hf, hb], 2)
            z = both @ w["out"] + x @ w["skip"] + w["base"][0]
            dz = np.where(mask, (_sigmoid(z) - y) / mask.sum(0)[None, :], 0).astype(np.float32) / len(some)
            g = {k: np.zeros_like(v) for k, v in w.items()}
            g["out"], g["base"][0] = np.einsum("tp,tph->h", dz, both), dz.sum()
            g["skip"] = np.einsum("tp,tpd->d", dz, x)
            dboth = dz[:, :, None] * w["out"]
            dx = dz[:, :, None] * w["skip"]
            dx = dx + _back(x, mask, w, "f", tf, dboth[:, :, : s.hidden], g) + _back(x, mask, w, "b", tb, dboth[:, :, s.hidden :], g)
            for p, (paths, words, _, _) in enumerate(some):
                for name, rows, low, high, root in (("path", paths, 0, s.path_dim, True), ("word", words, s.path_dim, s.path_dim + s.word_dim, False)):
                    sizes = np.array([len(r) for r in rows])
                    each = dx[: len(rows), p, low:high] / (np.sqrt(sizes) if root else sizes)[:, None]
                    np.add.at(g[name], np.concatenate(rows), np.repeat(each, sizes, axis=0))
            step += 1
            rate = s.rate * (1 - 0.9 * step / steps)
            for k in w:
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.005 * (g[k] * g[k] - v)
                w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-7)
    return w


# --- what the labeller learns from ---

# names that page authors give to parts of a page
MAIN = ["article", "main", "article.post", "div#content", "div.content", "div.article-body", "div.entry-content", "div.post-content", "section.story", "div.main-text", "main#main", "div.text", "div#article",
        "article.entry", "section#content", "div.post", "div.story-body", "div.page-content", "div.blog-post", "div.body"]
MENU = ["nav", "ul.menu", "div.navbar", "nav.main-nav", "div#menu", "div.breadcrumbs", "ul.nav", "div.topnav", "div.navigation", "nav.breadcrumb", "div.pagination", "div.tabs"]
HEAD = ["header", "div.header", "div#masthead", "header.site-header", "div.top", "div.banner", "div.logo", "header#header", "div.branding"]
FOOT = ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom", "section.footer", "div.legal"]
SIDE = ["aside", "div.sidebar", "div#sidebar", "aside.related", "div.widget", "div.related-posts", "div.recommended", "section.sidebar", "div.teaser", "div.more-stories", "div.tags", "div.share", "div.social", "div.author-box"]
NOTICE = ["div.cookie-notice", "div#cookie-banner", "div.notice", "div.alert", "div.popup", "div.modal", "div.consent", "section.notice", "div.gdpr", "div.message", "div.paywall", "p.notice", "div.disclaimer"]
ADVERT = ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div#ad-top", "aside.ad", "div.promo", "section.ad", "div.banner-ad", "ins.adsbygoogle", "div.sponsor"]
FORM = ["form", "form.newsletter", "div.subscribe", "form.search", "form.login", "div.signup", "form#contact", "div.newsletter-signup", "fieldset"]
COMMENT = ["section.comments", "div#comments", "div.comment-list", "ol.commentlist", "div.discussion", "section#comments", "ul.comments", "div.reader-comments", "div.responses", "div#disqus"]
CUES = {
    "head": ["Home", "Welcome", "The daily page", "Menu"], "foot": ["© 2024 All rights reserved", "Terms Privacy Contact", "Impressum", "&copy; example &middot; legal"],
    "side": ["Related", "Read more", "Most read", "Share this", "About the author", "Popular posts", "Tags"], "notice": ["We use cookies", "Accept", "This site uses cookies to improve your visit.", "Notice", "Please accept our terms"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Ad"], "form": ["Subscribe", "Your email", "Search", "Sign in", "Name", "Send"], "comment": ["Comments", "Reply", "says:", "2 days ago", "Leave a comment", "Anonymous"],
}
OUT = {"head": HEAD, "foot": FOOT, "side": SIDE, "notice": NOTICE, "advert": ADVERT, "form": FORM, "comment": COMMENT, "menu": MENU}
NOT_MAIN = frozenset("nav aside footer header form menu fieldset".split())
NOT_MAIN_NAMES = frozenset("ad ads advert advertisement sponsored comment comments commentlist sidebar related cookie notice newsletter promo share social menu nav".split())


def teach(blocks: list[Block]) -> np.ndarray | None:
    """Labels by the page's own ``article`` or ``main``; None where it marks none."""
    inside = np.array([any(n in ("/article", "/main") for n in b.path) for b in blocks], bool)
    if not inside.any():
        return None
    apart = np.array([any(n[1:] in (NOT_MAIN if n[0] == "/" else NOT_MAIN_NAMES) for n in b.path) for b in blocks], bool)
    return inside & ~apart


def _open(spec: str, rng: random.Random, plain: bool) -> tuple[str, ...]:
    tag, *names = re.findall(r"^[a-z]+|[.#][a-z-]+", spec)
    if plain:  # a name that tells nothing
        return ("/" + rng.choice(["div", "section", "div"]), "." + rng.choice("abcdefghijkl") + rng.choice("xyzqk"))
    return ("/" + tag, *[n[0] + part for n in names for part in n[1:].split("-")])


def dress(main: list[Block], rest: list[str], lines: list[str], rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """A made-up layout around the main blocks of a page."""
    blocks: list[Block] = []
    labels: list[bool] = []
    number = [0]
    plain = rng.random() < 0.15
    above: tuple[str, ...] = ("/html", "/body")
    for _ in range(rng.choice([0, 0, 1, 2])):
        above += _open(rng.choice(["div.wrapper", "div#page", "div.container", "div.row", "div.inner", "div.site", "section"]), rng, rng.random() < 0.3)

    def new() -> int:
        number[0] += 1
        return number[0]

    def add(path, text, linked, parent, y):
        text = " ".join(html.unescape(text).split())
        if text:
            blocks.append(Block(path, text, linked, parent))
            labels.append(y)

    def short() -> str:
        words = rng.choice(lines).split() if lines else ["the"]
        at = rng.randrange(len(words))
        return " ".join(words[at : at + rng.randint(1, 14)])

    def other(kind: str, base):
        spec = _open(rng.choice(OUT[kind]), rng, plain and rng.random() < 0.7)
        here, parent = base + spec, new()
        if kind == "menu":
            if rng.random() < 0.7:
                here, parent = here + ("/ul",), new()
            for _ in range(rng.randint(2, 9)):
                add(here + ("/li",), " ".join(short().split()[: rng.randint(1, 3)]), 1.0, parent, False)
            return
        cues = CUES[kind]
        n = {"comment": rng.randint(1, 6), "side": rng.randint(1, 6), "foot": rng.randint(1, 3)}.get(kind, rng.randint(1, 2))
        if rng.random() < 0.35:
            add(here + (f"/{rng.choice(['h2', 'h3', 'h4', 'p'])}",), rng.choice(cues), 0.0, parent, False)
        for _ in range(n):
            text = rng.choice(rest) if rest and rng.random() < 0.4 else short() if rng.random() < 0.7 else rng.choice(lines or ["the"])
            if rng.random() < 0.3:
                text = f"{rng.choice(cues)} {text}"
            inner, up = here, parent
            if kind == "comment" and rng.random() < 0.7:
                inner, up = here + _open(rng.choice(["article.comment", "div.comment", "li.comment", "div.comment-body"]), rng, plain), new()
            if kind == "side" and rng.random() < 0.4:
                inner, up = here + ("/ul",), parent
                add(inner + ("/li",), text, 1.0 if rng.random() < 0.7 else 0.0, up, False)
                continue
            leaf = rng.choice([(), ("/p",), ("/p",), ("/div",), ("/span",)[:0]])
            add(inner + leaf, text, rng.choice([0.0, 0.0, 0.3]), up if leaf else new(), False)

    for kind, chance in (("head", 0.5), ("menu", 0.8), ("notice", 0.35), ("advert", 0.5), ("form", 0.2), ("side", 0.2)):
        if rng.random() < chance:
            other(kind, above)
    spec = _open(rng.choice(MAIN), rng, plain and rng.random() < 0.7)
    inside, parent = above + spec, new()
    if rng.random() < 0.25:
        inside, parent = inside + _open(rng.choice(["div.inner", "div.body", "section", "div.text", "div"]), rng, False), new()
    for i, b in enumerate(main):
        tag = next((n for n in reversed(b.path) if n[0] == "/"), "/p")
        if tag not in ("/h1", "/h2", "/h3", "/p", "/li", "/blockquote", "/pre", "/td"):
            tag = "/p"
        leaf, up = (tag,), parent
        if rng.random() < 0.06:
            leaf, up = rng.choice([("/blockquote", "/p"), ("/ul", "/li"), ("/ol", "/li"), ("/table", "/tr", "/td"), ("/figure", "/figcaption"), ("/div", "/p"), ("/section", "/p"), ("/pre",)]), new()
        add(inside + leaf, b.text, 0.0 if rng.random() < 0.9 else rng.random() * 0.6, up, True)
        if i and rng.random() < 0.04:
            other(rng.choice(["advert", "side", "notice", "form"]), inside)
    base = inside if rng.random() < 0.3 else above
    for kind, chance in (("side", 0.15), ("comment", 0.4)):
        if rng.random() < chance:
            other(kind, base)
    for kind, chance in (("side", 0.35), ("advert", 0.25), ("form", 0.25), ("menu", 0.15), ("notice", 0.15), ("foot", 0.85)):
        if rng.random() < chance:
            other(kind, above)
    return blocks, np.array(labels, bool)


def learn(pages: DataFrame, settings: Settings = Settings(), html_col: str = "html") -> dict[str, np.ndarray]:
    """Weights learned from a bounded sample of the pages. The driver holds at most ``pages`` pages of ``page_chars``."""
    draw = pages.select(html_col).filter((F.length(html_col) > 0) & (F.length(html_col) <= settings.page_chars)).select(html_col, F.xxhash64(html_col, F.lit(settings.seed)).alias("draw")).distinct()
    rows = draw.orderBy("draw").limit(settings.pages).toArrow().to_pylist()
    rng = random.Random(settings.seed)
    taught = [(blocks, y) for r in rows if (blocks := read_blocks(r[html_col])) and (y := teach(blocks)) is not None and y.any()]
    lines = [b.text for blocks, y in taught for b, ok in zip(blocks, y) if ok] or [" ".join(c) for c in CUES.values()]
    rest = [b.text for blocks, y in taught for b, ok in zip(blocks, y) if not ok]
    examples = list(taught)
    for blocks, y in taught:
        main = [b for b, ok in zip(blocks, y) if ok]
        examples += [dress(main, rest, lines, rng) for _ in range(settings.dressed)]
    if not taught:  # nothing to learn from: layouts around lines of the names' own words
        examples = [dress([Block(("/p",), line, 0.0, 0) for line in rng.choices(lines, k=6)], [], lines, rng) for _ in range(400)]
    return train(examples, settings)


def extract(pages: DataFrame, weights: dict[str, np.ndarray], settings: Settings = Settings(), html_col: str = "html") -> DataFrame:
    """``pages`` with their main text in ``text``, in place of the html. A column named text is replaced."""
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    sent = pages.sparkSession.sparkContext.broadcast({"weights": weights, "settings": asdict(settings)})

    def texts(some: list[str], w, features) -> list[str]:
        parsed = [read_blocks(page) for page in some]
        return [" ".join(b.text for b, ok in zip(blocks, label(blocks, z)) if ok) if blocks else "" for blocks, z in zip(parsed, logits(parsed, w, features))]

    def tasks(batches):
        w, features = sent.value["weights"], Features(Settings(**sent.value["settings"]))
        for batch in batches:
            out, held, chars = [], [], 0
            for page in batch.column(len(kept)):
                page = page.as_py() or ""
                if held and (chars + len(page) > 1 << 21 or len(held) >= 512):
                    out += texts(held, w, features)
                    held, chars = [], 0
                held.append(page)
                chars += len(page)
            out += texts(held, w, features)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, pa.string())], [*kept, "text"])

    rows = pages.select(*kept, html_col)
    return rows.mapInArrow(tasks, StructType([*rows.schema.fields[:-1], StructField("text", StringType())]))
