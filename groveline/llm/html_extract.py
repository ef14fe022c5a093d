"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks; each is a vector of its hashed tag path (names, classes, ids), its
hashed words and a few measures. A bidirectional LSTM in numpy reads the blocks in page order and
labels each as article or not, so every label draws on the whole document. The weights are learned
when first needed, from pages that ``sample_page`` composes with known labels; seeds are fixed.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from groveline.llm._shared import read_table, slices

PATH_WIDTH, WORD_WIDTH, MEASURES, HIDDEN = 160, 48, 6, 20
WIDTH = PATH_WIDTH + WORD_WIDTH + MEASURES
TRAIN_PAGES, EPOCHS, RATE = 4000, 10, 0.01

#: A "<" outside quotes ends a tag; where quotes don't match, a tag ends at the next ">". So a page is read in linear time.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_NAME = re.compile(r"[a-z]+|\d+", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe head title".split())
#: Controls of forms: what they say is no block.
CONTROLS = frozenset("textarea select datalist optgroup option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mo mn ms mtext msup msub mfrac msqrt svg g text tspan object canvas".split())
#: An opening tag closes an open element of these kinds first, up to the nearest container.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_BLOCKY = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist", "optgroup"}}


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """Leaf blocks in page order: path tokens, text, characters in links. Scripts, styles, heads and controls give none; a hidden part's path says that it is hidden."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links, at, end = 0, 0, 0, len(page)

    def text(upto: int) -> None:
        nonlocal linked
        if upto > at:
            piece = page[at:upto]
            parts.append(piece)
            if links:
                linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if parts:
            body = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if body and not any(name in CONTROLS for name, _ in stack):
                out.append((tuple(t for _, own in stack for t in own), body, linked))
            parts.clear()
            linked = 0

    for m in _TAG.finditer(page, 0, page.rfind(">") + 1):
        if m.start() < at:
            continue
        text(m.start())
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3])
            continue
        name = m[2].lower()
        if name in INLINE:
            if name == "a":
                links = 0 if m[1] else 1
            if name == "br":
                parts.append(" ")
            continue
        if m[1]:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            if name != "p":
                links = 0
            continue
        flush()
        if name in RAW:
            if m[3].endswith("/"):
                continue
            over = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, at)
            at = end if over is None else (page.find(">", over.start()) + 1 or end)
            if name == "head" and over is None:
                body = re.compile(r"<body[\s>]", re.I).search(page, m.end())
                at = body.start() if body else m.end()
            continue
        if name in VOID:
            continue
        closes = CLOSES.get(name) or ({"p"} if name in _BLOCKY else set())
        i = len(stack) - 1
        while closes and i >= 0 and stack[i][0] not in _LIMITS.get(name, _BLOCKY - {"p"}):
            if stack[i][0] in closes:
                del stack[i:]
            i -= 1
        own = [name]
        for kind, a, b, c in _ATTRIBUTE.findall(m[3]):
            own += [f"{kind.lower()}:{x.lower()}" for x in _NAME.findall(a or b or c)]
        if _HIDDEN.search(m[3]):
            own.append("hidden")
        stack.append((name, tuple(own)))
    text(end)
    flush()
    return out


@lru_cache(1 << 16)
def _slot(token: str, width: int) -> int:
    return zlib.crc32(token.encode()) % width


def features(page: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    x = np.zeros((len(page), WIDTH), np.float32)
    for i, (path, body, linked) in enumerate(page):
        row = x[i]
        for t in path:
            row[_slot(t, PATH_WIDTH)] = 1
        words = body.lower().split(" ")
        distinct = set(words)
        weight = 0.5 * min(1.0, (12 / len(distinct)) ** 0.5)  # long blocks fill many slots, each of them less
        for w in distinct:
            row[PATH_WIDTH + _slot(w, WORD_WIDTH)] = weight
        n = len(body)
        row[PATH_WIDTH + WORD_WIDTH :] = (min(n, 1000) ** 0.5 / 16, min(linked / n, 1), len(words) < 4, body[-1] in ".!?:;\"'”»", i / len(page), min(len(page), 200) / 100)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("x", scale(WIDTH, 4 * HIDDEN)), ("h", scale(HIDDEN, 4 * HIDDEN)), ("c", np.zeros(4 * HIDDEN, np.float32)))}
        for d in "fb":
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.w |= {"o": scale(2 * HIDDEN, 1), "s": scale(WIDTH, 1) * np.float32(0.1), "q": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        steps, n, _ = x.shape
        gates = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w[f"h{d}"]
            i, f, o, g = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = (f * c + i * g) * m
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, new))
            c = new
            h = out[t] = o * np.tanh(c) * m
        return out

    def score(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: steps x pages x WIDTH; mask 1 where a page has a block."""
        both = np.concatenate([self._run(x, mask, d, None if keep is None else keep.setdefault(d, [])) for d in "fb"], 2)
        if keep is not None:
            keep["both"] = both
        return _sigmoid((both @ self.w["o"] + x @ self.w["s"] + self.w["q"])[..., 0])

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, state: dict) -> float:
        """One Adam step on the mean log loss."""
        keep: dict = {}
        p = self.score(x, mask, keep)
        total = mask.sum()
        delta = ((p - y) * mask / total)[..., None].astype(np.float32)
        flat_x = x.reshape(-1, WIDTH)
        grads = {"o": keep["both"].reshape(-1, 2 * HIDDEN).T @ delta.reshape(-1, 1), "s": flat_x.T @ delta.reshape(-1, 1), "q": delta.sum((0, 1))}
        back = delta @ self.w["o"].T
        for d, at in (("f", 0), ("b", HIDDEN)):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            gh = np.zeros_like(self.w[f"h{d}"])
            for t, i, f, o, g, c, h, new in reversed(keep[d]):
                m = mask[t][:, None]
                e = (back[t][:, at : at + HIDDEN] + dh) * m
                th = np.tanh(new)
                dc = (dc + e * o * (1 - th * th)) * m
                z = dz[t]
                z[:, :HIDDEN], z[:, HIDDEN : 2 * HIDDEN] = dc * g * i * (1 - i), dc * c * f * (1 - f)
                z[:, 2 * HIDDEN : 3 * HIDDEN], z[:, 3 * HIDDEN :] = e * th * o * (1 - o), dc * i * (1 - g * g)
                gh += h.T @ z
                dh, dc = z @ self.w[f"h{d}"].T, dc * f
            grads |= {f"h{d}": gh, f"x{d}": flat_x.T @ dz.reshape(-1, 4 * HIDDEN), f"c{d}": dz.sum((0, 1))}
        state["n"] = n = state.get("n", 0) + 1
        for k, g in grads.items():
            g = g + 1e-5 * self.w[k]
            m, v = state.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            state[k] = m, v
            self.w[k] = (self.w[k] - state["rate"] * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return float(-(mask * np.log(np.where(y > 0, p, 1 - p) + 1e-9)).sum() / total)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Article or not, for each block of each page; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            take = max(1, min(len(order), (1 << 14) // len(pages[order[-1]])))
            part, order = order[-take:], order[:-take]
            x, mask, _ = pad([pages[i] for i in part])
            p = self.score(x, mask)
            for k, i in enumerate(part):
                out[i] = p[: len(pages[i]), k] >= 0.5
        return out


def pad(pages: list[np.ndarray], labels: list[np.ndarray] | None = None):
    steps = max(map(len, pages))
    x, mask, y = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
        if labels is not None:
            y[: len(p), k] = labels[k]
    return x, mask, y


#: Names that page authors give to parts of a page.
ARTICLE = ("article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "div#content", "section.article", "div.post-content", "article.post", "main#main", "div.text", "div.page-content", "td.content", "div#main-content", "div.body", "")
OTHER = {
    "menu": ("nav", "ul.menu", "div.nav", "div.navbar", "div#menu", "ul.navigation", "div.breadcrumb", "nav.main-nav", "div.topnav", "ol.breadcrumbs", "div.pagination", "ul.tabs", "div.toc"),
    "header": ("header", "div.header", "div#header", "div.masthead", "div.site-header", "div.topbar", "div.banner", "div.logo"),
    "footer": ("footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.legal", "div.bottom", "div.colophon"),
    "sidebar": ("aside", "div.sidebar", "div#sidebar", "div.widget", "aside.related", "div.related", "div.recommended", "div.trending", "section.more", "div.social", "div.share", "div.tags", "div.author-box", "div.popular", "div.right-col"),
    "notice": ("div.cookie", "div.cookie-notice", "div.consent", "div.notice", "div#gdpr", "div.alert", "div.popup", "div.modal", "div.newsletter", "div.subscribe", "div.paywall", "section.notice", "div.message", "div.promo-bar"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div#ad", "div.promo", "aside.ad", "div.banner-ad", "div.adsense", "section.ad", "div.ad-container", "ins.adsbygoogle"),
    "form": ("form", "form.search", "div.search", "form.login", "form#subscribe", "fieldset", "form.contact"),
    "comments": ("div.comments", "section.comments", "div#comments", "ol.commentlist", "div.comment", "section#comments", "div.disqus", "div.replies", "ul.comment-list", "div.discussion", "div.responses", "div.reader-comments"),
}
_PHRASES = ("Home", "About", "Contact us", "Log in", "Sign up", "Read more", "Share this", "All rights reserved.", "Privacy policy", "Subscribe to our newsletter.", "This site uses cookies.", "Accept", "Related articles", "Leave a comment", "Reply", "Advertisement", "Search", "Next", "Previous", "Menu", "© 2020")


def _open(spec: str) -> tuple[str, str]:
    name, kind, value = re.fullmatch(r"(\w*)([.#]?)([\w-]*)", spec).groups()
    if not name:
        return "", ""
    return (f"<{name}>" if not kind else f'<{name} {"class" if kind == "." else "id"}="{value}">'), f"</{name}>"


def sample_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A composed page and the label of each of its blocks in order."""
    pool = ["".join(rng.choice("aeioubcdfghklmnprstvwz") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    labels: list[bool] = []

    def words(n: int) -> str:
        return " ".join(rng.choice(pool) for _ in range(n))

    def sentence(low: int, high: int) -> str:
        return words(rng.randint(low, high)).capitalize() + rng.choice(("." , ".", ".", "!", "?", ",", ""))

    def block(tag: str, body: str, good: bool) -> str:
        labels.append(good)
        if rng.random() < 0.15:
            body = f'<b>{body[: len(body) // 2]}</b>{body[len(body) // 2 :]}'
        return f"<{tag}>{body}</{tag}>" if rng.random() < 0.93 or tag != "p" else f"<{tag}>{body}"

    def article() -> str:
        tag, close = _open(rng.choice(ARTICLE) if rng.random() < 0.6 else "article")
        out = [tag]
        if rng.random() < 0.8:
            wrap = rng.random() < 0.15
            out.append(("<header>" if wrap else "") + block(rng.choice(("h1", "h1", "h2")), sentence(1, 14), True) + ("</header>" if wrap else ""))
        brief = rng.random() < 0.2
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = rng.random()
            if kind < 0.75:
                out.append(block("p", words(rng.randint(1, 3)) if rng.random() < 0.1 else sentence(1, 3) if brief else " ".join(sentence(1, 25) for _ in range(rng.choice((1, 1, 2, 4)))), True))
            elif kind < 0.83:
                out.append(block(rng.choice(("h2", "h3", "h4")), sentence(1, 7), True))
            elif kind < 0.9:
                out.append("<ul>" + "".join(block("li", (f'<a href="/{pool[0]}">{words(2)}</a> ' if rng.random() < 0.3 else "") + sentence(1, 12), True) for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.94:
                out.append("<blockquote>" + block("p", sentence(5, 20), True) + "</blockquote>")
            elif kind < 0.96:
                out.append(block("pre", words(8), True))
            else:
                out.append(other(rng.choice(("advert", "sidebar", "notice", "form"))))
        return "".join([*out, close])

    def other(kind: str) -> str:
        tag, close = _open(rng.choice(OTHER[kind]))
        out = [tag]
        say = lambda low, high: rng.choice(_PHRASES) if rng.random() < 0.3 else sentence(low, high)
        if kind == "menu" or kind in ("header", "footer", "sidebar") and rng.random() < 0.4:
            out.append("<ul>" + "".join(block("li", f'<a href="/{pool[1]}">{say(1, 3)}</a>', False) for _ in range(rng.randint(2, 7))) + "</ul>")
        elif kind == "form":
            out += [block(rng.choice(("p", "div", "legend")), say(1, 6), False) + "<input name=q>" for _ in range(rng.randint(1, 3))]
        else:
            for _ in range(rng.choice((1, 1, 2, 4)) if kind != "comments" else rng.randint(1, 6)):
                roll = rng.random()
                if roll < 0.35 and kind != "comments" and len(out) == 1:
                    labels.append(False)
                    out.append(say(1, 20))
                    break
                out.append(block("p" if roll < 0.85 else rng.choice(("div", "h3", "h4")), " ".join(say(1, 20) for _ in range(rng.choice((1, 1, 3)))), False))
        return "".join([*out, close])

    order = [k for k in ("header", "menu", "notice", "advert", "sidebar", "form") if rng.random() < 0.45]
    if rng.random() < 0.3:
        rng.shuffle(order)
    body = [other(k) for k in order]
    body.append(article())
    tail = [k for k in ("advert", "sidebar", "comments", "menu", "notice", "form", "footer") if rng.random() < 0.45]
    if rng.random() < 0.3:
        rng.shuffle(tail)
    body += [other(k) for k in tail]
    wrap = rng.choice(("", "", '<div class="wrapper">', '<div id="page">', '<div class="container">'))
    shut = "</div>" if wrap else ""
    page = f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{margin:0}}</style></head><body>{wrap}{''.join(body)}{shut}</body></html>"
    return page, labels


def samples(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng, xs, ys = random.Random(seed), [], []
    while len(xs) < n:
        page, labels = sample_page(rng)
        found = blocks(page)
        if found and len(found) == len(labels):
            x = features(found)
            if rng.random() < 0.5:
                x[:, PATH_WIDTH:] = 0  # the path alone has to do for half of the pages
            xs.append(x)
            ys.append(np.array(labels, np.float32))
    return xs, ys


@lru_cache(2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    xs, ys = samples(pages, seed)
    order = sorted(range(len(xs)), key=lambda i: len(xs[i]))
    groups = [order[i : i + 32] for i in range(0, len(order), 32)]
    model, state, rng = Labeller(), {}, random.Random(seed)
    for e in range(epochs):
        state["rate"] = RATE * (1 - e / epochs)
        rng.shuffle(groups)
        for g in groups:
            model.step(*pad([xs[i] for i in g], [ys[i] for i in g]), state)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row (page_id, url, html): blocks of the article joined by blank lines.

    Null or empty html, or a page without article blocks, gives empty text. Rows are independent, so
    repeated ones are read alike; pages of any length are read whole; an empty table gives an empty one.
    """
    model = model or trained()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            found = [blocks(p or "") for p in batch.column(2).to_pylist()]
            texts = ["\n\n".join(b[1] for b, ok in zip(f, good, strict=True) if ok) for f, good in zip(found, model.label([features(f) for f in found]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(label, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
