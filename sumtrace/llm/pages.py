"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut at its block-level tags into leaf blocks, the runs of text that no such tag parts.
Each block is described by the tags, classes and ids of its ancestors and by its text: length,
share of linked characters, punctuation, place on the page. A conditional random field with two
labels (main text or not) over the sequence of blocks is trained by AdaGrad on the likelihood of
labelled pages and decoded by Viterbi, so that a block's neighbours count too.

The labelled pages are written by :func:`labelled_pages` in many layouts: the article in an
``article``, ``main``, ``div`` or ``section`` with varying names, amid menus, headers, footers,
sidebars, notices, adverts, forms, sharing links and reader comments, with the label of each
block known as it is written. Callers may give their own.

Scripts, styles, comments and the like are no text. Character references are decoded, white space
within a block becomes one space, and the blocks of the main text are joined by line feeds. Markup
may be broken: a block tag ends an open paragraph, end tags without a beginning are passed over, and
what is left open ends with the page.

Edge cases: null and empty html have an empty text, as have pages without main text. Every row comes
out once, whatever its id. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrace.llm.common import arrow_batches

EPOCHS = 12
RATE = 0.3
PAGES = 240
REMEMBERED = 50_000
DEEPEST = 512  # elements within each other; deeper ones count as on this level, as in browsers

_NO_TEXT = "script|style|template|svg|math|iframe|object|noscript|textarea|select|canvas|audio|video"
_TAG = re.compile(
    rf"<!--.*?(?:-->|$)|<({_NO_TEXT})\b[^<>]*(?:/>|>.*?(?:</\1\s*>|$))|<[!?][^<>]*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|/)?)>",
    re.I | re.S,
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+")
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table menu select body".split())


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]  # ancestors from the outermost, each as tag and names
    linked: int  # characters within links


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}  # one tuple for equal paths
    texts: list[str] = []
    state = [0, 0]  # open links, characters within links

    def add(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if state[0]:
                state[1] += len(text.strip())

    def flush() -> None:
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                path = tuple(e for _, e in stack)
                out.append(Block(text, paths.setdefault(path, path), state[1]))
            texts.clear()
        state[1] = 0

    def close(at: int) -> None:
        del stack[at:]

    page, end = page or "", 0
    for m in _TAG.finditer(page):
        add(page[end : m.start()])
        end = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            texts.append(" ")
            continue
        if tag == "a":
            state[0] = 0 if m.group(2) else 1
            continue
        if tag not in _BLOCK:
            continue
        flush()
        if tag in _VOID:
            continue
        if m.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == "p" or stack[i][0] in _ENDS_ITSELF.get(tag, ()):
                close(i)
                break
            if stack[i][0] in _LISTS:
                break
        if not m.group(4).endswith("/") and len(stack) < DEEPEST:
            stack.append((tag, _element(tag, m.group(4))))
    add(page[end:])
    flush()
    return out


def _element(tag: str, attributes: str) -> str:
    if not attributes.strip():
        return tag
    names = {p for m in _NAME.finditer(attributes) for p in _PART.findall((m.group(2) or m.group(3) or m.group(4) or "").lower())}
    return " ".join([tag, *sorted(names)])


@cache
def _element_features(element: str) -> tuple[str, ...]:
    tag, *names = element.split(" ")
    return (f"in {tag}", *[f"named {n}" for n in names])


def path_features(path: tuple[str, ...]) -> list[str]:
    out = {f for e in path for f in _element_features(e)}
    return [f"under {path[-1].split(' ')[0]}" if path else "under none", *sorted(out)]


def text_features(block: Block, place: float) -> list[str]:
    text, n = block.text, block.text.count(" ") + 1
    share = block.linked / max(1, len(text))
    out = [
        "words " + ("1" if n < 2 else "few" if n < 6 else "some" if n < 15 else "many" if n < 40 else "most"),
        "linked " + ("none" if share < 0.05 else "some" if share < 0.5 else "all"),
        "end " + ("stop" if text[-1] in ".!?…\"”" else "open"),
    ]
    if "©" in text or "copyright" in text.lower():
        out.append("has ©")
    if place == 0 or place == 1:
        out.append("first" if place == 0 else "last")
    return out


class Model(NamedTuple):
    weight: dict[str, float]  # for main text against not
    turn: np.ndarray  # 2 x 2, from label to label
    start: float


def _observed(page: list[Block]) -> list[list[str]]:
    last = max(1, len(page) - 1)
    return [["any", *path_features(b.path), *text_features(b, i / last)] for i, b in enumerate(page)]


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> Model:
    """Train on pages as blocks and labels (1: main text)."""
    observed = [_observed(b) for b, _ in pages]
    index: dict[str, int] = {}
    for page in observed:
        for names in page:
            for name in names:
                index.setdefault(name, len(index))
    rows = [[np.array([index[f] for f in names]) for names in page] for page in observed]
    weight, turn, start = np.zeros(len(index)), np.zeros((2, 2)), 0.0
    seen, seen_turn, seen_start = np.full(len(index), 1e-2), np.full((2, 2), 1e-2), 1e-2
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for p in rng.permutation(len(pages)):
            own, labels = rows[p], np.array(pages[p][1])
            n = len(own)
            if not n:
                continue
            emit = np.array([[0.0, weight[r].sum()] for r in own])
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = emit[0] + [0.0, start]
            for i in range(1, n):
                forward[i] = emit[i] + np.logaddexp(forward[i - 1][0] + turn[0], forward[i - 1][1] + turn[1])
            for i in range(n - 2, -1, -1):
                backward[i] = np.logaddexp(turn[:, 0] + emit[i + 1][0] + backward[i + 1][0], turn[:, 1] + emit[i + 1][1] + backward[i + 1][1])
            whole = np.logaddexp(*forward[-1])
            main = np.exp(forward[:, 1] + backward[:, 1] - whole)
            grad = np.zeros_like(weight)
            for r, e in zip(own, labels - main):
                grad[r] += e
            grad -= 1e-3 * weight
            g_turn = -1e-3 * turn
            for i in range(1, n):
                pair = np.exp(forward[i - 1][:, None] + turn + (emit[i] + backward[i])[None, :] - whole)
                g_turn -= pair
                g_turn[labels[i - 1], labels[i]] += 1
            g_start = labels[0] - main[0]
            seen += grad * grad
            seen_turn += g_turn * g_turn
            seen_start += g_start * g_start
            weight += rate * grad / np.sqrt(seen)
            turn += rate * g_turn / np.sqrt(seen_turn)
            start += rate * g_start / np.sqrt(seen_start)
    return Model({name: float(weight[i]) for name, i in index.items()}, turn, float(start))


def decode(emit: list[float], model: Model) -> list[int]:
    """The most likely labels (Viterbi)."""
    if not emit:
        return []
    (oo, om), (mo, mm) = model.turn.tolist()
    other, main, back = 0.0, emit[0] + model.start, []
    for e in emit[1:]:
        to_other = (other + oo, 0) if other + oo >= main + mo else (main + mo, 1)
        to_main = (other + om, 0) if other + om > main + mm else (main + mm, 1)
        back.append((to_other[1], to_main[1]))
        other, main = to_other[0], to_main[0] + e
    label = 1 if main > other else 0
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def main_text(page: str | None, model: Model, memory: dict | None = None) -> str:
    """Main text of one page."""
    memory = {} if memory is None else memory
    own, weight = blocks(page), model.weight
    last, emit = max(1, len(own) - 1), []
    for i, block in enumerate(own):
        base = memory.get(block.path)
        if base is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            base = memory[block.path] = weight["any"] + sum(weight.get(f, 0.0) for f in path_features(block.path))
        emit.append(base + sum(weight.get(f, 0.0) for f in text_features(block, i / last)))
    return "\n".join(b.text for b, label in zip(own, decode(emit, model)) if label)


_SYLLABLES = [consonant + vowel for consonant in "dgklmn" for vowel in "aeiou"][:26]


def labelled_pages(n: int = PAGES, seed: int = 17) -> list[tuple[str, dict[str, int]]]:
    """Pages in varying layouts, each with the label of every block's text."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        label: dict[str, int] = {}

        def say(words: int, main: int, stop: bool = True) -> str:
            while True:
                text = " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(max(1, words)))
                text = text.capitalize() + ("." if stop else "")
                if text not in label:
                    label[text] = main
                    return text

        def prose(main: int) -> str:
            return say(r.choice([1, 2, 4, 8, 15, 30, 60, 120]), main, r.random() < 0.9)

        def links(k: int) -> str:
            items = [f'<a href="#">{say(r.randint(1, 3), 0, False)}</a>' for _ in range(k)]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else "".join(f"<p>{x}</p>" for x in items)

        def wrapped(tags: list[str], inner: str) -> str:
            tag = r.choice(tags)
            return f"<{tag}>{inner}</{tag.split(' ')[0]}>"

        def named(kind: str, tags: str, names: str) -> list[str]:
            return [kind] + [f'{t} {a}="{x}"' for t in tags.split() for x in names.split() for a in ("class", "id")]

        def paragraphs(main: int, k: int) -> str:
            form = r.random()
            if form < 0.2:  # paragraphs that are never closed
                return "".join(f"<p>{prose(main)}" for _ in range(k))
            if form < 0.4:
                return "".join(f"<p><b>{say(r.randint(3, 9), main)}<br><p>{prose(main)}</p>" for _ in range(k))
            return "".join(f"<p>{prose(main)}</p>" for _ in range(k))

        ad = lambda: wrapped([f'div class="{x}"' for x in "ad ads advert advertisement sponsor sponsored promo banner".split()] + ["aside"], r.choice([prose(0), f"<p>{prose(0)}</p>"]))
        notice = lambda: wrapped([f'div class="{x}"' for x in "cookie-notice notice consent alert popup newsletter subscribe".split()], f"<p>{prose(0)}</p>")
        form = lambda: f"<form><p>{say(4, 0)}</p><label>{say(1, 0, False)}</label><button>{say(1, 0, False)}</button></form>"
        share = lambda: wrapped([f'div class="{x}"' for x in "share social related breadcrumb pagination tags meta byline".split()], r.choice([links(3), say(3, 0, False)]))
        comments = lambda: wrapped(
            ['section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="responses"', 'section id="discussion"'],
            "".join(r.choice([f'<div class="comment"><p>{prose(0)}</p></div>', f'<li class="comment">{prose(0)}</li>', f"<p>{prose(0)}</p>"]) for _ in range(r.randint(1, 5))),
        )
        body = [f"<{h}>{say(r.randint(2, 9), 1, r.random() < 0.5)}</{h}>" for h in ["h1"] if r.random() < 0.85]
        for _ in range(r.randint(1, 7)):
            kind = r.random()
            if kind < 0.6:
                body.append(paragraphs(1, r.randint(1, 4)))
            elif kind < 0.7:
                body.append(f"<h2>{say(r.randint(2, 6), 1, False)}</h2>{paragraphs(1, 2)}")
            elif kind < 0.78:
                body.append("<ul>" + "".join(f"<li>{prose(1)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.84:
                body.append(f"<blockquote>{prose(1)}</blockquote>")
            else:
                body.append(r.choice([ad, notice, form, share])())
        article = wrapped(["article"] * 8 + ["main"] * 3 + named("main", "div section", "content post entry article story text"), "".join(body))
        before = [f for f, p in ((f"<nav>{links(5)}</nav>", 0.7), (wrapped(named("header", "div", "header masthead top menu navbar"), prose(0) + links(3)), 0.5), (ad(), 0.6), (notice(), 0.3)) if r.random() < p]
        after = [f for f, p in ((comments(), 0.5), (wrapped(named("aside", "div", "sidebar related widget"), f"<p>{prose(0)}</p>" + links(3)), 0.5), (form(), 0.3), (ad(), 0.3), (wrapped(named("footer", "div", "footer bottom copyright"), r.choice(["&copy; ", ""]) + prose(0)), 0.8)) if r.random() < p]
        if r.random() < 0.12:  # nothing but the article
            before, after = [], []
        r.shuffle(before)
        whole = f"<html><head><title>{say(6, 0, False)}</title></head><body>" + "".join(before) + article + "".join(after)
        out.append((whole + ("</body></html>" if r.random() < 0.9 else ""), label))
    return out


def trained(pages: list[tuple[str, dict[str, int]]] | None = None, **settings) -> Model:
    """A model from labelled pages: html, and the label of each block's text."""
    pages = labelled_pages() if pages is None else pages
    cut = [(blocks(page), label) for page, label in pages]
    return fit([(b, [label.get(x.text.removeprefix("© "), 0) for x in b]) for b, label in cut], **settings)


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text) of every row."""
    spark = pages.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def of(batches):
        memory: dict = {}
        for batch in batches:
            texts = [main_text(x.as_py(), sent.value, memory) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(of, "page_id long, url string, text string")
