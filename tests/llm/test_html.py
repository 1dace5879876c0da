"""The block parser and the labeller against plain loops."""

import html as entities
import math
import random
import re
import time

import numpy as np
import pytest

from tessera.llm import html


def plain_blocks(page):
    """(text, path) of leaf blocks for pages without quotes in odd places: lists are searched, paths are copied."""
    out, path, held = [], [], []

    def flush():
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((text, tuple(path)))
        held.clear()

    at = 0
    while at < len(page):
        m = re.compile(r"<!--.*?-->|</?[a-zA-Z][^>]*>|<[/!?][^>]*>", re.S).search(page, at)
        held.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at, tag = m.end(), m[0]
        name = re.match(r"</?([a-zA-Z][^\s/>]*)", tag)
        if tag.startswith("<!") or name is None:
            continue
        name = name[1].lower()
        if name in html.BLOCK:
            flush()
        if tag[1] == "/":
            if name in path:
                del path[len(path) - 1 - path[::-1].index(name) :]
            continue
        if name in html.RAW:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            held.append(" ")
        if name in html.VOID:
            continue
        if name in html._P_ENDS and "p" in path:
            del path[len(path) - 1 - path[::-1].index("p") :]
        if name in html.CLOSES:
            ends, bars = html.CLOSES[name]
            for i in range(len(path) - 1, -1, -1):
                if path[i] in bars:
                    break
                if path[i] in ends.split():
                    del path[i:]
                    break
        path.append(name)
    flush()
    return out


def soup(r):
    names = ["div", "p", "li", "ul", "td", "tr", "table", "a", "b", "br", "section", "dd", "dl", "script", "option", "img"]
    parts = []
    for _ in range(r.randint(1, 60)):
        n = r.choice(names)
        parts.append(r.choice([f"<{n}>", f"<{n} class='x y{r.randint(0, 3)}'>", f"</{n}>", f"</{n}>", "word ", "a &amp; b ", "<!-- c -->", "<!doctype html>", " < 3 "]))
    return "".join(parts)


ARTICLE = "<article><h1>Head line</h1><p>First words.</p><p>Last words.</p></article>"


@pytest.mark.parametrize("before", ["<html><head><title>x</title>", "<head><meta charset=utf-8><title>x</title><style>p {}</style>", "<html><head><title>x</title></head><noscript>", "<svg>", "<svg><path d='x'>",
                                    "<template>", "<iframe src=x>", "<object>", "<title>", "<head><noscript><img src=x>", "<noscript><p>", "<HEAD>", "<canvas>", "<math>", "<script>a</script><noscript>"])
@pytest.mark.parametrize("after", ["", "<noscript>off</noscript>"])
def test_an_element_without_its_end_hides_nothing(before, after):
    for body in ("<body>", ""):
        got = [b.text for b in html.blocks(before + body + ARTICLE + after)]
        assert [t for t in got if t != "off"][-3:] == ["Head line", "First words.", "Last words."]


@pytest.mark.parametrize("name", ["script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "noframes"])
def test_an_element_with_its_end_hides_its_content(name):
    page = f"<html><head><title>t</title></head><body><p>a</p><{name} class='x'>hidden &lt;p&gt; <i>words</i></{name.upper()} ><p>b</p><{name}/><p>c</p></body>"
    assert [b.text for b in html.blocks(page)] == ["a", "b", "c"]
    if name in ("script", "style", "textarea"):  # these run on
        assert [b.text for b in html.blocks(f"<p>a</p><{name}><p>b</p>")] == ["a"]


def test_only_attributes_of_these_names_count():
    (b,) = html.blocks("<div data-id=menu data-role='nav' title=\"class='ad' hidden\" xclass=y ID=main><p>x")
    want = ["div", "id:main", "p"]
    assert b.depth == len(want) and b.tokens == sum(1 << k for k in {html._hash(t, html.PATH - 1) for t in want})


@pytest.mark.parametrize("seed", range(6))
def test_blocks_are_those_of_a_plain_parser(seed):
    r, g = random.Random(seed), np.random.default_rng(seed)
    for page in [soup(r) for _ in range(200)] + [html.example(g)[0] for _ in range(10)]:
        got = [(b.text, b.last if ":" not in b.last else None, b.depth) for b in html.blocks(page)]
        want = plain_blocks(page)
        assert [t for t, _, _ in got] == [t for t, _ in want]
        for (_, last, depth), (_, path) in zip(got, want):
            assert depth >= len(path) and (last is None or last == (path[-1] if path else ""))


def test_tokens_of_the_path_are_all_there():
    parts = [f"c{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(40)]
    (b,) = html.blocks(f'<div class="{" ".join(parts)}" id=top hidden><p>x')
    want = ["div", *[f"class:{p}" for p in parts], "id:top", "hidden", "p"]
    assert b.depth == len(want) and b.tokens == sum(1 << k for k in {html._hash(t, html.PATH - 1) for t in want}) and b.last == "p"


def test_every_word_counts():
    a, b = (html.vectors(html.blocks("<p>" + "same " * 200 + w))[0] for w in ("one", "other"))
    assert (a[html.PATH : html.PATH + html.WORDS] != b[html.PATH : html.PATH + html.WORDS]).any()


@pytest.mark.parametrize("piece", ['<div class="a">x', "<a '>", '<p title="x', "<li>y", "<a \"'>x", "<!-- ", "<svg>", "</p>", "<table><tr><td>1"])
def test_time_grows_with_the_page(piece):
    took = []
    for n in (4000, 32_000):
        began = time.perf_counter()
        html.blocks(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.2


def test_labeller_is_a_bidirectional_lstm():
    """One block and one number at a time."""
    r = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in html.model().items()}
    x = r.normal(size=(7, 1, html.PATH + html.WORDS + html.MEASURES))
    h = html.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))
    states = {}
    for side, order in (("f", range(7)), ("b", range(6, -1, -1))):
        state, cell = [0.0] * h, [0.0] * h
        for t in order:
            g = [float(w[f"c{side}"][j] + sum(x[t, 0, i] * w[f"x{side}"][i, j] for i in range(x.shape[2])) + sum(state[i] * w[f"h{side}"][i, j] for i in range(h))) for j in range(4 * h)]
            cell = [sig(g[h + k]) * cell[k] + sig(g[k]) * math.tanh(g[3 * h + k]) for k in range(h)]
            state = [sig(g[2 * h + k]) * math.tanh(cell[k]) for k in range(h)]
            states[side, t] = state
    want = [sum(a * b for a, b in zip([*states["f", t], *states["b", t]], w["o"])) + float(x[t, 0] @ w["d"]) + float(w["e"][0]) for t in range(7)]
    assert np.allclose(html.logits(w, x, np.ones((7, 1), bool))[:, 0], want)


def test_the_weights_are_the_trainers():
    """A short training from the same pages goes the same way as the shipped one: few blocks of fresh pages are labelled wrongly."""
    r = np.random.default_rng(123)
    for weights, most in ((html.model(), 0.01), (html.train(200, 5), 0.06)):
        wrong = total = 0
        for _ in range(80):
            page, labels = html.example(r)
            got = html.labels_of(weights, [html.blocks(page)])[0]
            if len(got) == len(labels):
                wrong, total = wrong + int((got != np.array(labels, bool)).sum()), total + len(labels)
        assert wrong <= most * total
