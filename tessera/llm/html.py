"""Main text of web pages by a recurrent block labeller.

A page is split into leaf blocks: text between the tags of block elements, with the path of open elements
(names, classes, ids, roles) above it.  Scripts, styles, comments and the head never give blocks.  Every block
becomes a vector of hashed path tokens, hashed words (all of them) and a few measures (length, share of link text,
punctuation, place), and a bidirectional LSTM in numpy reads the page's whole sequence of vectors and labels
each block as main text or not.  Kept blocks are joined in page order.  Reading a page takes time in proportion to its length,
however deep its elements nest and however broken its markup is.

The model was trained by `train` from pages that `example` composes (menus, headers, sidebars, adverts,
notices, forms and reader comments around and inside an article, in many markups, of random words, so only
structure and context tell), TRAIN_PAGES of them with a fixed seed; `python -m tessera.llm.html` writes its weights to WEIGHTS.

Nulls: null html is empty and gives an empty text.  Pages are independent, so repeated rows get equal results; other columns are handed
through as a struct, whatever their names.  An unfinished tag at the end of a page is dropped, an unknown character reference stays as written.
"""

from __future__ import annotations

import functools
import html as _entities
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# HTML element names by how they bear on blocks.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object canvas noframes".split())
#: Of these, what no end tag ends runs on; without an end tag of their own others don't hide what follows.  Those of the second kind don't nest.
ENDLESS = frozenset("script style textarea".split())
SINGLE = frozenset("title noscript iframe canvas noframes".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

PATH, WORDS, MEASURES, HIDDEN = 96, 32, 8, 16
TRAIN_PAGES = 900
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_weights.npz")

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_TELLS = frozenset("class id role hidden aria-label".split())
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENDS = {n: re.compile(rf"</{n}\b[^>]*(?:>|\Z)" + (rf"|<{n}\b" if n in SINGLE else ""), re.I) for n in RAW}
_PART = re.compile(r"[a-z]+")
_P_ENDS = BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "option", "optgroup", "legend", "li", "dd", "dt"} | {"li", "dd", "dt"}


class Block:
    """A leaf: its text, the share of it in links, and of the path above it the hashed tokens (bits), their number and the last."""

    __slots__ = ("tokens", "depth", "last", "text", "linked")

    def __init__(self, tokens: int, depth: int, last: str, text: str, linked: float):
        self.tokens, self.depth, self.last, self.text, self.linked = tokens, depth, last, text, linked


@functools.lru_cache(100_000)
def _hash(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


class _Tags:
    """Pieces of a page: (text, None), (name, attributes) of a start tag, ("/" + name, "")."""

    def __init__(self, page: str):
        self.page = page
        self.broken = 0  # before this place a quote doesn't close, so tags end at their first ">"
        self.unended: dict[str, int] = {}  # by name, where no end tag is left from

    def end(self, at: int) -> int:
        """Where the tag that starts here ends: a ">" outside quotes; -1 if it never does."""
        if at >= self.broken:
            i = at
            while m := _MARK.search(self.page, i):
                if m[0] == ">":
                    return m.start()
                i = self.page.find(m[0], m.end()) + 1
                if not i:
                    self.broken = m.end()
                    break
        return self.page.find(">", at)

    def hidden(self, name: str, at: int) -> int:
        """Where the content ends that an element of RAW hides from here."""
        if at < self.unended.get(name, len(self.page) + 1):
            for m in _ENDS[name].finditer(self.page, at):
                if m[0][1] == "/":
                    return m.end()
                if name in SINGLE:  # another one begins, so this one has no end
                    return at
            self.unended[name] = at
        return len(self.page) if name in ENDLESS else at

    def __iter__(self):
        page, at, text = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                upto = page.find("-->", at + 4) + 3
                name = None
            else:
                m = _NAME.match(page, at)
                if m is None and page[at + 1 : at + 2] not in ("/", "!", "?"):
                    at += 1
                    continue
                upto, name = self.end(at) + 1, m and m[1].lower()
            if at > text:
                yield page[text:at], None
            if upto <= 2:  # unfinished
                return
            if name is not None:
                if page[at + 1] == "/":
                    yield "/" + name, ""
                else:
                    own = page[m.end() : upto - 1]
                    yield name, own
                    if name in RAW and not own.endswith("/"):
                        upto = self.hidden(name, upto)
            at = text = upto
        if text < len(page):
            yield page[text:], None


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    names: list[str] = []
    above: list[tuple[int, int, str]] = [(0, 0, "")]
    places: dict[str, list[int]] = {}
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(_entities.unescape("".join(held)).split())
            if text:
                out.append(Block(*above[-1], text, linked / max(1, sum(map(len, held)))))
            held.clear()
            linked = 0

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def close(upto: int) -> None:
        while len(names) > upto:
            places[names.pop()].pop()
            above.pop()

    for name, own in _Tags(page):
        if own is None:
            held.append(name)
            if places.get("a"):
                linked += len(name)
            continue
        if name[0] == "/":
            name = name[1:]
            if name in BLOCK:
                flush()
            if (at := last(name)) >= 0:
                close(at)
            continue
        if name in BLOCK:
            flush()
        if name == "br":
            held.append(" ")
        if name in RAW or name in VOID or name == "head":  # a head may end without a tag, and holds no text of its own
            continue
        if name in _P_ENDS and (at := last("p")) >= 0:
            close(at)
        if name in CLOSES:
            ends, bars = CLOSES[name]
            if (at := max(map(last, ends.split()))) > max(map(last, bars)):
                close(at)
        tokens, depth, end = above[-1]
        found = [name]
        for a in _ATTR.finditer(own):
            if a[1].lower() not in _TELLS:
                continue
            value = (a[2] or a[3] or a[4] or "").lower()
            found += [f"{a[1].lower()}:{v}" for v in _PART.findall(value)] or [a[1].lower()]
        for end in found:
            tokens |= 1 << _hash(end, PATH - 1)
        places.setdefault(name, []).append(len(names))
        names.append(name)
        above.append((tokens, depth + len(found), end))
    flush()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """A row per block."""
    n = len(page)
    out = np.zeros((n, PATH + WORDS + MEASURES), np.float32)
    if not n:
        return out
    tokens = np.frombuffer(b"".join(b.tokens.to_bytes(PATH // 8, "little") for b in page), np.uint8).reshape(n, -1)
    out[:, : PATH - 1] = np.unpackbits(tokens, axis=1, count=PATH - 1, bitorder="little")
    out[:, PATH - 1] = np.minimum([b.depth for b in page], 20) / 20
    hashes, words = C.word_hashes([b.text.lower().encode("utf-8", "replace") for b in page])
    seen = np.bincount(np.repeat(np.arange(n), words) * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    each = np.maximum(words, 1)
    out[:, PATH : PATH + WORDS] = seen / each[:, None]
    measures = np.array([(len(b.text), b.linked, b.text[-1] in ".!?…»”\"", "©" in b.text, b.text.count("."), b.last == "p") for b in page], np.float64)
    long, linked, ended, right, stops, plain = measures.T
    out[:, PATH + WORDS :] = np.stack([np.minimum(np.log1p(long) / 8, 1.5), np.minimum(np.log1p(words) / 6, 1.5), linked, ended, np.arange(n) / n, right, stops / each, plain], axis=1)
    return out


# ---------------------------------------------------------------- the network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = PATH + WORDS + MEASURES, HIDDEN
    w: dict[str, np.ndarray] = {}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * h))
        w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        w[f"c{side}"] = np.zeros(4 * h)
        w[f"c{side}"][h : 2 * h] = 1  # remember at first
    return w | {"o": rng.normal(0, 0.3, 2 * h), "d": rng.normal(0, 0.05, d), "e": np.zeros(1)}


def _pass(w: dict, side: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Hidden states of one direction over (time, page, feature); with keep, what the way back needs."""
    h, steps = HIDDEN, x.shape[0]
    gates = x @ w[f"x{side}"] + w[f"c{side}"]
    state, cell = np.zeros((x.shape[1], h), x.dtype), np.zeros((x.shape[1], h), x.dtype)
    out, kept = np.empty((steps, x.shape[1], h), x.dtype), []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        g = gates[t] + state @ w[f"h{side}"]
        i, f, o = (_sigmoid(g[:, k * h : (k + 1) * h]) for k in range(3))
        u = np.tanh(g[:, 3 * h :])
        m = mask[t][:, None]
        new = f * cell + i * u
        th = np.tanh(new)
        if keep:
            kept.append((t, i, f, o, u, cell, state, th, m))
        cell = np.where(m, new, cell)
        state = np.where(m, o * th, state)
        out[t] = state
    return out, kept


def logits(w: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    both = np.concatenate([_pass(w, s, x, mask)[0] for s in "fb"], axis=2)
    return both @ w["o"] + x @ w["d"] + w["e"]


def gradients(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the blocks and its gradients, back through time."""
    h, n = HIDDEN, max(1, int(mask.sum()))
    runs = {s: _pass(w, s, x, mask, True) for s in "fb"}
    both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
    p = _sigmoid(both @ w["o"] + x @ w["d"] + w["e"])
    loss = -np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0).sum() / n
    err = np.where(mask, p - y, 0) / n
    g = {"o": np.einsum("tb,tbh->h", err, both), "d": np.einsum("tb,tbd->d", err, x), "e": np.array([err.sum()])}
    for k, s in enumerate("fb"):
        gx, gh, gc = np.zeros_like(w[f"x{s}"]), np.zeros_like(w[f"h{s}"]), np.zeros_like(w[f"c{s}"])
        d_state, d_cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        for t, i, f, o, u, cell, state, th, m in reversed(runs[s][1]):
            d_out = d_state + err[t][:, None] * w["o"][k * h : (k + 1) * h]
            own = np.where(m, d_out, 0)
            new = np.where(m, d_cell, 0) + own * o * (1 - th * th)
            d_gate = np.concatenate([new * u * i * (1 - i), new * cell * f * (1 - f), own * th * o * (1 - o), new * i * (1 - u * u)], axis=1)
            gx += x[t].T @ d_gate
            gh += state.T @ d_gate
            gc += d_gate.sum(0)
            d_state = d_gate @ w[f"h{s}"].T + np.where(m, 0, d_out)
            d_cell = new * f + np.where(m, 0, d_cell)
        g |= {f"x{s}": gx, f"h{s}": gh, f"c{s}": gc}
    return float(loss), g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), PATH + WORDS + MEASURES), np.float32)
    mask = np.zeros((longest, len(pages)), bool)
    for j, v in enumerate(pages):
        x[: len(v), j], mask[: len(v), j] = v, True
    return x, mask


# ---------------------------------------------------------------- training pages

_MENU = ("nav", "ul.menu", "div.navbar", "div#nav", "div.menu", "div.breadcrumbs", "div.topnav", "ul#navigation")
_HEAD = ("header", "div.header", "div#header", "div.masthead", "div.site-title")
_FOOT = ("footer", "div.footer", "div#footer", "div.copyright", "div.site-info")
_SIDE = ("aside", "div.sidebar", "div#sidebar", "div.widget", "div.related", "div.recommended", "section.popular")
_ADS = ("div.ad", "div.ads", "div.advert", "div.banner", "div.sponsored", "ins.adsbygoogle", "div.promo", "section.advertisement", "p.ad")
_NOTE = ("div.cookie", "div.notice", "div.cookie-banner", "div.alert", "div#consent", "div.newsletter", "div.popup", "div.gdpr", "section.notice", "p.notice")
_FORM = ("form", "form.search", "form#subscribe", "div.login", "form.contact")
_TALK = ("section.comments", "div.comments", "div#comments", "ol.commentlist", "section#comments", "div.discussion", "ul.comments", "section.reader-comments")
_MAIN = ("article", "article", "main", "div.content", "div#content", "div.post", "div.entry-content", "section.article", "div.article-body", "main article", "div.story", "div#main article", "body")


def example(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A composed page and the labels of its blocks."""
    letters = np.array(list("abcdefghijklmnoprstuvwyzäéñü"))
    vocabulary = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(60)]
    out: list[str] = []
    labels: list[int] = []

    def say(low: int, high: int, stop: bool = True) -> str:
        w = [str(x) for x in rng.choice(vocabulary, rng.integers(low, high))]
        return " ".join(w).capitalize() + ("." if stop else "")

    def block(tag: str, text: str, label: int, ended: bool = True) -> None:
        out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if ended else ""))
        labels.append(label)

    def within(where: str, body) -> None:
        parts = []
        for x in where.split():
            tag, mark, value = re.match(r"(\w+)([.#]?)(.*)", x).groups()
            parts.append(tag)
            out.append(f"<{tag}" + (f' {"class" if mark == "." else "id"}="{value}"' if mark else "") + ">")
        body()
        out.extend(f"</{t}>" for t in reversed(parts))

    def text(label: int, low: int = 4, high: int = 14, stop: bool = True):
        return lambda: block(str(rng.choice(["p", "div", "span", ""])) or "p", say(low, high, stop), label) if rng.random() < 0.5 else (out.append(say(low, high, stop)), labels.append(label))

    def menu() -> None:
        out.append("<ul>")
        for _ in range(rng.integers(3, 9)):
            block("li", f'<a href="/x">{say(1, 4, False)}</a>', 0)
        out.append("</ul>")

    def talk() -> None:
        for _ in range(rng.integers(1, 5)):
            within(str(rng.choice(["div.comment", "li.comment", "article.comment", "div.reply"])), lambda: [block(str(rng.choice(["p", "div"])), say(3, 40), 0) for _ in range(rng.integers(1, 3))])

    def side() -> None:
        if rng.random() < 0.5:
            block("h3", say(1, 4, False), 0)
        menu() if rng.random() < 0.5 else block("p", say(4, 30), 0)

    def form() -> None:
        block("label", say(1, 4, False), 0) if rng.random() < 0.0 else block("p", say(2, 12), 0)
        out.append('<input type="text"><button>')
        out.append("</button>")

    def clutter(share: float) -> None:
        for names, body in ((_ADS, text(0)), (_NOTE, text(0, 4, 25)), (_FORM, form), (_SIDE, side), (_MENU, menu)):
            if rng.random() < share:
                within(str(rng.choice(names)), body)

    def article() -> None:
        if rng.random() < 0.85:
            block(str(rng.choice(["h1", "h1", "h2"])), say(3, 12, False), 1)
        for _ in range(int(rng.integers(1, 14) if rng.random() < 0.75 else rng.integers(14, 70))):
            kind = rng.random()
            if kind < 0.68:
                loose = rng.random() < 0.15
                block("p", ("<b>" if rng.random() < 0.2 else "") + say(1, 90 if rng.random() < 0.6 else 12) + ("<br>" if loose else ""), 1, not loose)
            elif kind < 0.76:
                block(str(rng.choice(["h2", "h3"])), say(2, 8, False), 1)
            elif kind < 0.84:
                out.append("<ul>")
                for _ in range(rng.integers(2, 6)):
                    block("li", say(2, 16, bool(rng.random() < 0.5)), 1)
                out.append("</ul>")
            elif kind < 0.9:
                block(str(rng.choice(["blockquote", "pre", "dd", "td"])), say(3, 40), 1)
            elif kind < 0.95:
                block("p", f'{say(3, 30)} <a href="/y">{say(1, 4, False)}</a> {say(3, 20)}', 1)
            else:
                clutter(0.15)

    out.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
    top = [(_MENU, menu, 0.85), (_HEAD, text(0, 1, 8, False), 0.4), (_ADS, text(0), 0.6), (_NOTE, text(0, 4, 25), 0.3), (_FORM, form, 0.2)]
    for k in rng.permutation(len(top)):
        if rng.random() < top[k][2]:
            within(str(rng.choice(top[k][0])), top[k][1])
    if rng.random() < 0.15:
        within(str(rng.choice(_SIDE)), side)
    inside = rng.random() < 0.2

    def body() -> None:
        article()
        if inside:
            within(str(rng.choice(_TALK)), talk)

    where = str(rng.choice(_MAIN))
    body() if where == "body" else within(where, body)
    if not inside and rng.random() < 0.4:
        within(str(rng.choice(_TALK)), talk)
    clutter(0.2)
    if rng.random() < 0.85:
        within(str(rng.choice(_FOOT)), lambda: (out.append("&copy; " + say(3, 25)), labels.append(0)))
    page = "".join(out)
    return page, labels


def train(pages: int = TRAIN_PAGES, epochs: int = 14, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        page, labels = example(rng)
        found = blocks(page)
        if len(found) == len(labels):
            data.append((vectors(found), np.array(labels, np.float64)))
    w = initial(rng)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(epochs):
        order = np.argsort([len(d[1]) + rng.random() * 12 for d in data])
        groups = [order[a : a + 24] for a in range(0, len(order), 24)]
        for g in rng.permutation(len(groups)):
            x, mask = padded([data[i][0] for i in groups[g]])
            y = np.zeros(mask.shape)
            for j, i in enumerate(groups[g]):
                y[: len(data[i][1]), j] = data[i][1]
            step += 1
            rate = 0.012 * (1 - 0.8 * epoch / epochs)
            for k, grad in gradients(w, x.astype(np.float64), mask, y)[1].items():
                grad = np.clip(grad, -1, 1) + 1e-5 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in w.items()}


@functools.cache
def model() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return {k: f[k].astype(np.float32) for k in f}


def labels_of(w: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """True for main text, by page and block; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and upto - at < 256 and len(pages[order[upto]]) * (upto - at) < 20_000:
            upto += 1
        group = order[at:upto]
        x, mask = padded([vectors(pages[i]) for i in group])
        z = logits(w, x, mask)
        for j, i in enumerate(group):
            out[i] = z[: len(pages[i]), j] > 0
        at = upto
    return out


def main_text(w: dict, html: list[str]) -> list[str]:
    pages = [blocks(x) for x in html]
    return ["\n".join(b.text for b, keep in zip(p, k) if keep) for p, k in zip(pages, labels_of(w, pages))]


def _extract(weights):
    def run(batches):
        for batch in batches:
            html = [x or "" for x in batch.column("_html").to_pylist()]
            text: list[str] = []
            for at in range(0, len(html), 512):
                text += main_text(weights, html[at : at + 512])
            yield pa.record_batch([batch.column(0), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["row", "text", "n_chars"])

    return run


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """(row, text, n_chars): row is a struct of the other columns."""
    C.ship(df.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != html_col]).alias("row")
    source = df.select(row, F.col(f"`{html_col}`").alias("_html"))
    return source.mapInArrow(_extract(model()), source.select("row").schema.add("text", "string").add("n_chars", "long"))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: x.astype(np.float16) for k, x in train().items()})
