"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (text between block-level tags), each with its chain of open
elements.  Features are ancestor tags, words of their classes and ids, and the text's length,
punctuation, links and signs.  Weights are trained by stochastic gradient on the conditional
likelihood (forward and backward sums) over ``PAGES`` labelled pages, which a small grammar of
page layouts writes with known labels; the fixed seed makes training repeatable.  Viterbi finds
the best labelling of the whole page, and the blocks labelled as content are joined.

Null and empty pages give an empty text.  Unclosed elements end with the page; stray end tags
count for nothing.  A head ends at its end tag, or before the first tag or text that cannot stand
in one; only an unclosed script, style or textarea hides the rest of the page.  Repeated rows are
treated alike.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty

PAGES = 800
EPOCHS = 6
SEED = 11
_TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:-->|--!>|\Z)|<(?:(script|style|textarea)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    # without an end tag the next ones are elements like others, but a select takes its options along
    r"|(template|svg(?![^<>]*/>))(?=[\s/>]).*?</\2\s*>|(noscript|iframe|select|title)(?=[\s/>])(?:(?!<\3\b).)*?</\3\s*>"
    r"|(select)(?=[\s/>])[^>]*>(?:[^<]|<(?=/?(?:option|optgroup)\b))*)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements that leave a head open.
_HEAD = frozenset("html head title base basefont bgsound link meta noscript noframes template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output q rb rp rt rtc ruby s samp slot small span strike strong sub sup time tt u var wbr".split())
_PLAIN = frozenset("html body div section p blockquote center h1 h2 h3 h4 h5 h6 li ul ol pre table tbody tr td th main article".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def blocks(page: str) -> list[tuple[str, tuple[tuple[str, str], ...], float]]:
    """(text, chain of (tag, names), share of linked characters) of each leaf block."""
    out: list = []
    chain: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = in_link = 0
    in_head = in_title = False

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((text, tuple(chain), min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    done = 0
    for m in _TOKEN.finditer(page):
        if m.start() > done:
            if in_head and not in_title:
                in_head = page[done : m.start()].isspace()
            if not in_head:
                parts.append(page[done : m.start()])
                linked += (m.start() - done) * (in_link > 0)
        done = m.end()
        if hidden := m[1] or m[2] or m[3] or m[4]:
            in_head = in_head and hidden.lower() not in ("select", "textarea", "svg", "iframe")
            if hidden.lower() in ("select", "textarea", "iframe", "title"):
                flush()
            continue
        end, tag, attributes = (m[5], m[6], m[7]) if m[6] else (m[8], m[9], m[10])
        if not tag:
            continue
        tag = tag.lower()
        in_title = False
        if tag == "head":
            flush()
            in_head = not end
            continue
        if in_head:
            # stray end tags say nothing; without its end tag a title lasts to the next tag
            in_head = tag not in ("body", "html", "br") if end else tag in _HEAD
            in_title = in_head and tag == "title" and not end
            if in_head:
                continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if end else 1
            continue
        flush()
        if end:
            for k in range(len(chain) - 1, -1, -1):
                if chain[k][0] == tag:
                    del chain[k:]
                    break
            continue
        in_link = 0
        if tag in _CLOSES_P and chain and chain[-1][0] == "p":
            chain.pop()
        if tag in ("li", "td", "th", "tr", "dd", "dt", "option") and chain and chain[-1][0] == tag:
            chain.pop()
        if tag not in _VOID and not attributes.endswith("/"):
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if attributes else ""
            chain.append((tag, names))
    if done < len(page) and not in_title:
        parts.append(page[done:])
    flush()
    return out


def _above(chain) -> list[str]:
    f = {f"tag={t}" for t, _ in chain} | {f"name={w}" for _, n in chain if n for w in _WORD.findall(n)}
    if chain:
        f.add(f"leaf={chain[-1][0]}")
    # the nearest name says most
    if near := next((n for _, n in reversed(chain) if n), ""):
        f |= {f"near={w}" for w in _WORD.findall(near)}
    # page parts that say nothing of what they are
    if not any(n for _, n in chain):
        f.add("unnamed")
        if all(t in _PLAIN for t, _ in chain):
            f.add("plain")
    return sorted(f)


def _within(text: str, linked: float) -> list[str]:
    n = text.count(" ") + 1
    marks = sum(map(text.count, ".,;:!?"))
    f = [f"words={min(8, n.bit_length())}", f"marks={min(4, int(math.log2(1 + marks)))}", f"linked={int(linked * 4)}"]
    if "©" in text:
        f.append("copyright")
    if text[-1] in ".!?…\"”":
        f.append("sentence")
    return f


class Model:
    """Weights of features for content against boilerplate, and of transitions."""

    def __init__(self, weights: dict[str, float], stay: list[list[float]]):
        self.weights, self.stay, self.known = weights, stay, {}

    def score(self, block) -> float:
        text, chain, linked = block
        if (above := self.known.get(chain)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            above = self.known[chain] = sum(self.weights.get(f, 0.0) for f in _above(chain))
        return above + sum(self.weights.get(f, 0.0) for f in _within(text, linked))

    def label(self, page_blocks) -> list[bool]:
        """Viterbi."""
        t, back = self.stay, []
        best = [0.0, 0.0]
        for k, b in enumerate(page_blocks):
            s = self.score(b)
            if k:
                from0 = best[0] + t[0][0] >= best[1] + t[1][0], best[0] + t[0][1] > best[1] + t[1][1]
                back.append((0 if from0[0] else 1, 0 if from0[1] else 1))
                best = [max(best[0] + t[0][0], best[1] + t[1][0]), s + max(best[0] + t[0][1], best[1] + t[1][1])]
            else:
                best = [0.0, s]
        if not page_blocks:
            return []
        y = [int(best[1] > best[0])]
        for step in reversed(back):
            y.append(step[y[-1]])
        return [bool(v) for v in reversed(y)]

    def text(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b[0] for b, y in zip(found, self.label(found), strict=True) if y)


#: How pages mark what is not their main text, as (tag, class or id words).
BOILERPLATE = {
    "menu": [("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("ul", "navigation"), ("div", "navbar"), ("div", "breadcrumb"), ("div", "pagination"), ("nav", "toc")],
    "header": [("header", ""), ("div", "header"), ("div", "site-header masthead"), ("div", "top banner"), ("header", "page-header")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright legal")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("div", "related"), ("div", "widget"), ("aside", "side recommended"), ("div", "tags"), ("div", "popular trending")],
    "notice": [("div", "cookie"), ("div", "cookie-consent banner"), ("div", "notice"), ("div", "modal popup"), ("div", "subscribe newsletter"), ("div", "alert"), ("div", "gdpr privacy"), ("dialog", "")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert sponsored"), ("div", "promo"), ("aside", "ad"), ("div", "banner-ad advertisement"), ("section", "promotion")],
    "form": [("form", ""), ("form", "search"), ("div", "login"), ("form", "contact signup")],
    "comments": [("section", "comments"), ("div", "comment"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "discussion replies"), ("section", "responses"), ("div", "disqus")],
    "share": [("div", "share"), ("div", "social"), ("div", "author-bio byline")],
}
#: How pages mark their main text.
CONTENT = [("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article-body"), ("div", "post-content entry"), ("section", "story"), ("div", "main"), ("div", "text"), ("div", ""), ("main", "content")]


def _prose(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    for k in range(0, len(words), rng.randint(5, 12)):
        words[k] = words[k].capitalize()
        if k:
            words[k - 1] += rng.choice([".", ".", ",", "?"])
    return " ".join(words) + rng.choice([".", ".", ".", "!", ""])


def labelled_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page, and the texts of its content blocks."""
    wanted: set[str] = set()

    def wrap(tag: str, names: str, inner: str) -> str:
        attribute = f' {rng.choice(["class", "id"])}="{names}"' if names else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def junk(kind: str) -> str:
        tag, names = rng.choice(BOILERPLATE[kind])
        if kind == "menu":
            inner = "".join(f'<li><a href="#">{_prose(rng, 1, 2)}</a></li>' for _ in range(rng.randint(2, 7)))
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
        elif kind == "footer":
            inner = rng.choice(["<p>", ""]) + "&copy; " + _prose(rng, 2, 8)
        elif kind == "comments":
            inner = "".join(rng.choice(["<p>", "<div>", "<li>"]) + _prose(rng, 3, 60) for _ in range(rng.randint(1, 4)))
        elif kind == "form":
            inner = f"<label>{_prose(rng, 1, 3)}</label><input><button>{_prose(rng, 1, 2)}</button>"
        else:
            inner = "".join(rng.choice(["<p>", "<div>", "<h3>", ""]) + _prose(rng, 2, 30) for _ in range(rng.randint(1, 3)))
        return wrap(tag, names, inner)

    def plain(inner: str) -> str:
        return f"<div>{inner}</div>" if rng.random() < 0.2 else inner

    def story() -> str:
        out = []
        for k in range(rng.randint(1, 14)):
            tag = "h1" if not k and rng.random() < 0.8 else rng.choice(["p"] * 8 + ["h2", "blockquote", "li", "pre", "td", "div"])
            text = _prose(rng, *((2, 10) if tag[0] == "h" else (1, 90)))
            if tag == "p" and rng.random() < 0.03:
                text = f"\u00a9 {rng.randint(1950, 2030)} {text}"
            wanted.add(text)
            inner = rng.choice([text, text, f"<b>{text}"])
            inner = f"<ul><li>{inner}</ul>" if tag == "li" else f"<table><tr><td>{inner}</table>" if tag == "td" else f"<{tag}>{inner}</{tag}>"
            out.append(inner)
            if rng.random() < 0.12:
                out.append(junk(rng.choice(["advert", "share", "notice", "sidebar", "menu"])))
        if rng.random() < 0.15:
            out.append(junk(rng.choice(["comments", "share", "form"])))
        return "".join(out)

    bare = rng.random() < 0.2
    before = [] if bare else [plain(junk(k)) for k in ("notice", "header", "menu", "advert") if rng.random() < 0.55]
    after = [] if bare else [plain(junk(k)) for k in ("comments", "form", "sidebar", "menu", "advert", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    kind = rng.random()
    body = story() if kind < 0.12 else wrap("div", "", story()) if kind < 0.35 else wrap(*rng.choice(CONTENT), story())
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
        body = wrap(rng.choice(["div", "div", "section"]), rng.choice(["", "", "wrapper", "container", "page", "layout row", "inner", "col"]), body + (after.pop(0) if after and rng.random() < 0.4 else ""))
    return f"<html><head><title>{_prose(rng, 2, 6)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", wanted


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """A model from ``pages`` labelled pages: a sample of fixed size, so the driver fits it."""
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        page, wanted = labelled_page(rng)
        found = blocks(page)
        data.append(([_above(c) + _within(t, a) for t, c, a in found], [int(t in wanted) for t, _, _ in found]))
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    stay, seen_stay = [[0.0, 0.0], [0.0, 0.0]], [[1e-6, 1e-6], [1e-6, 1e-6]]

    def plus(a: float, b: float) -> float:
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    for _ in range(epochs):
        rng.shuffle(data)
        for feats, gold in data:
            n = len(gold)
            s = [sum(w.get(f, 0.0) for f in fs) for fs in feats]
            fore = [(0.0, s[0])] if n else []
            for k in range(1, n):
                a, b = fore[-1]
                fore.append((plus(a + stay[0][0], b + stay[1][0]), s[k] + plus(a + stay[0][1], b + stay[1][1])))
            back = [(0.0, 0.0)] * n
            for k in range(n - 2, -1, -1):
                a, b = back[k + 1][0], back[k + 1][1] + s[k + 1]
                back[k] = (plus(stay[0][0] + a, stay[0][1] + b), plus(stay[1][0] + a, stay[1][1] + b))
            whole = plus(*fore[-1]) if n else 0.0
            for k in range(n):
                g = math.exp(fore[k][1] + back[k][1] - whole) - gold[k]
                for f in feats[k]:
                    d = g + decay * w.get(f, 0.0)
                    seen[f] = seen.get(f, 1e-6) + d * d
                    w[f] = w.get(f, 0.0) - rate * d / math.sqrt(seen[f])
                if k:
                    for i in (0, 1):
                        for j in (0, 1):
                            p = math.exp(fore[k - 1][i] + stay[i][j] + (s[k] if j else 0.0) + back[k][j] - whole)
                            d = p - (gold[k - 1] == i and gold[k] == j)
                            seen_stay[i][j] += d * d
                            stay[i][j] -= rate * d / math.sqrt(seen_stay[i][j])
    return Model(w, stay)


def main_text(pages: DataFrame, html_col: str = "html", out: str = "text", model: Model | None = None) -> DataFrame:
    """Adds ``out``, the main text of each page."""
    model = model or train()
    weights, stay = model.weights, model.stay

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(weights, stay)
        for s in batches:
            yield pd.Series([m.text(p) for p in s], dtype=object)

    return pages.withColumn(out, run(text_or_empty(html_col)))
