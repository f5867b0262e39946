"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: stretches of text between block-level tags, with
the block-level elements they lie in.  Each block gets features of its ancestors'
tags, of the words in their class, id and role, of its text, and of its place: a
block's holder is the nearest element around it that holds other blocks too, and the
holder with most text outside links is the page's main one; features say whether a
block lies in it, under it, before or after it, whether a named element stands
between, whether it lies outside the `article` or `main` of a page that has one, and
how long and how linked the blocks of its holder are.  The chain adds
weights for neighbouring labels.  The field is fitted by gradient ascent on
labelled pages and decoded by Viterbi; the blocks labelled as content are joined.

Labelled pages come from a bounded sample (``SAMPLE`` pages, by hash of the id):
blocks in an `article` or `main` element, but not in one of `ASIDE`, are content.
Their texts are also laid out anew in page forms where the labels are known by
construction.  In half of these, elements of both kinds draw their names from the same
made-up words, so that place and shape must tell them apart; every plain tag stands
on both sides.

Defined results: a null or empty page, or one without content, has an empty text;
nothing is cut; unclosed and stray tags are read as a browser would, roughly;
repeated rows and null ids are read like others; an empty table gives no rows.
Other columns are not used.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import Batches

SAMPLE = 300
# Fixed values of the language: elements that stand inside a line, have no end tag, or hold no text.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br img".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg select".split())
# Without an end tag these reach to the end of the page; the others of RAW hold nothing then.
TO_END = set("script style title textarea".split())
# An opening tag of the second kind ends an open element of the first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Elements that stand for a piece of text or a list of them, not for a part of the page.
PIECES = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tr td th figure figcaption".split())
ASIDE = set("nav header footer aside form menu button dialog head".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
PIECE = re.compile(r"[a-z]+")
END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}


class Block:
    __slots__ = ("text", "path", "links")

    def __init__(self, text: str, path: tuple, links: int):
        self.text, self.path, self.links = text, path, links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; a path is ((tag, class words, number of the element), ...) from the root."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, int]] = []
    opened = 0
    pieces: list[str] = []
    linked = in_link = 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, tuple(stack), linked))
        pieces.clear()
        linked = 0

    def write(piece: str):
        nonlocal linked
        pieces.append(piece)
        if in_link:
            linked += len(piece)

    def pop_to(names: set, until: set = frozenset()):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    at = 0
    endless: set[str] = set()  # no end tag follows
    while True:
        m = TAG.search(page, at)
        if m is None:
            write(page[at:])
            break
        write(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                write(" ")
            elif name == "a":
                in_link = 0 if m.group(1) else 1
            continue
        flush()
        in_link = 0 if name not in VOID else in_link
        if m.group(1):
            pop_to({name})
            continue
        if name in RAW:
            if name == "svg" and m.group(3).rstrip().endswith("/"):
                continue
            end = None if name in endless else END[name].search(page, at)
            if end:
                at = end.end()
            elif name in TO_END:
                at = len(page)
            else:
                endless.add(name)
            continue
        if name in CLOSES:
            pop_to(CLOSES[name], {"ul", "ol", "dl", "table"})
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name not in VOID and not m.group(3).rstrip().endswith("/"):
            words = tuple(PIECE.findall(" ".join("".join(g) for g in NAMED.findall(m.group(3))).lower()))
            opened += 1
            stack.append((name, words, opened))
    flush()
    return out


def _size(n: int) -> str:
    return "0" if n < 4 else "1" if n < 10 else "2" if n < 25 else "3" if n < 80 else "4"


def _places(page_blocks: list[Block]) -> list[list[str]]:
    """Features of where each block lies; the root of a page has number 0."""
    held: dict[int, int] = {}
    for b in page_blocks:
        for _, _, number in b.path:
            held[number] = held.get(number, 0) + 1
    holders, names = [], []
    for b in page_blocks:
        holder, named = 0, False
        for tag, words, number in reversed(b.path):
            if tag not in PIECES and held[number] > 1:
                holder = number
                break
            named = named or bool(words)
        holders.append(holder)
        names.append(named)
    within = [any(tag in ("article", "main") for tag, _, _ in b.path) for b in page_blocks]
    whole: dict[int, list[int]] = {}
    for b, holder, inside in zip(page_blocks, holders, within, strict=True):
        own = whole.setdefault(holder, [0, 0, 0, 0])
        own[0] += 1
        own[1] += b.text.count(" ") + 1
        own[2] += b.links
        own[3] += len(b.text)
        if inside or not any(within):
            aside = any(tag in ASIDE for tag, _, _ in b.path)
            own.append(0 if aside else len(b.text) - b.links)
    main = max(whole, key=lambda h: sum(whole[h][4:]), default=0)
    own = [i for i, h in enumerate(holders) if h == main]
    out = []
    for i, (b, holder) in enumerate(zip(page_blocks, holders, strict=True)):
        n, words, links, size = whole[holder][:4]
        if holder == main:
            at = "main"
        elif any(number == main for _, _, number in b.path) or not main:
            between = [w for _, w, number in b.path if number > main]
            at = "under-named" if any(between) else "under"
        else:
            at = "out"
        found = [
            "at:" + at,
            f"at:{at}:named:{names[i]}",
            "holder-words:" + _size(words // n),
            "holder-linked:" + str(min(3, 4 * links // max(size, 1))),
        ]
        if own and not own[0] <= i <= own[-1]:
            found.append("before" if i < own[0] else "after")
        if any(within) and not within[i]:
            found.append("outside")
        out.append(found)
    return out


def features(page_blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, (b, place) in enumerate(zip(page_blocks, _places(page_blocks), strict=True)):
        own = ["bias"]
        for tag, words, _ in b.path:
            if tag not in ("html", "body", "div"):
                own.append("in:" + tag)
            own += ["class:" + w for w in words]
        own = list(dict.fromkeys(own))
        tag = b.path[-1][0] if b.path else "none"
        words = b.text.count(" ") + 1
        own += [
            "tag:" + tag,
            "words:" + _size(words),
            "linked:" + str(min(3, 4 * b.links // max(len(b.text), 1))),
            "stop:" + str(b.text[-1] in ".!?"),
        ]
        own += place
        if "©" in b.text:
            own.append("copyright")
        if i == 0:
            own.append("first")
        if i == len(page_blocks) - 1:
            own.append("last")
        out.append(own)
    return out


class Field:
    """Two labels, 0 boilerplate and 1 content: weights of features, of neighbours, of the start."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.moves = np.zeros((2, 2))

    def _scores(self, page: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum() for f in page])

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4):
        """Gradient ascent on the log-likelihood, page by page, with adaptive steps."""
        for page, _ in pages:
            for own in page:
                for f in own:
                    self.names.setdefault(f, len(self.names))
        self.weights = np.zeros(len(self.names))
        square, square_moves = np.full(len(self.names), 1e-3), np.full((2, 2), 1e-3)
        coded = [([[self.names[f] for f in own] for own in page], np.array(y)) for page, y in pages if page]
        order = random.Random(13)
        for _ in range(rounds):
            order.shuffle(coded)
            for page, y in coded:
                content, between = self._marginals(self._scores(page))
                gap = y - content
                for own, g in zip(page, gap.tolist(), strict=True):
                    step = g - decay * self.weights[own]
                    square[own] += step * step
                    self.weights[own] += rate * step / np.sqrt(square[own])
                if len(y) > 1:
                    seen = np.zeros((2, 2))
                    np.add.at(seen, (y[:-1], y[1:]), 1)
                    step = seen - between - decay * self.moves
                    square_moves += step * step
                    self.moves += rate * step / np.sqrt(square_moves)
        return self

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of content for each block; expected count of each pair of neighbours."""
        n = len(scores)
        unary = np.stack([np.zeros(n), scores], axis=1)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = unary[0]
        for i in range(1, n):
            ahead[i] = unary[i] + np.logaddexp(ahead[i - 1][0] + self.moves[0], ahead[i - 1][1] + self.moves[1])
        for i in range(n - 2, -1, -1):
            x = unary[i + 1] + back[i + 1]
            back[i] = np.logaddexp(self.moves[:, 0] + x[0], self.moves[:, 1] + x[1])
        total = np.logaddexp(*ahead[-1])
        content = np.exp(ahead[:, 1] + back[:, 1] - total)
        pair = ahead[:-1, :, None] + self.moves[None] + (unary + back)[1:, None, :] - total
        return content, np.exp(pair).sum(axis=0)

    def decode(self, page: list[list[str]]) -> list[int]:
        """Most likely labels of all blocks together (Viterbi); unknown features say nothing."""
        names, weights = self.names, self.list_weights()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b, back = 0.0, None, []
        for own in page:
            s = sum([weights[names[f]] for f in own if f in names])
            if b is None:
                a, b = 0.0, s
                continue
            to0, to1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((to0, to1))
            a, b = (b + m10 if to0 else a + m00), (b + m11 if to1 else a + m01) + s
        if b is None:
            return []
        labels = [int(b > a)]
        for to in reversed(back):
            labels.append(int(to[labels[-1]]))
        return labels[::-1]

    def list_weights(self) -> list[float]:
        if not hasattr(self, "_list"):
            self._list = self.weights.tolist()
        return self._list


# Class and id words that pages commonly use for what is not the article.
AWAY = (
    "ad ads advert advertisement banner promo sponsor sponsored sidebar menu navbar navigation breadcrumb breadcrumbs "
    "cookie consent notice alert popup modal newsletter subscribe share social related comments comment reply "
    "footer header masthead topbar login search widget pagination tags copyright"
).split()
HOME = "article content post entry story text body main page".split()
# Names that say nothing: both kinds of elements get them.
NEUTRAL = [a + b for a in ("ka", "lo", "mi", "ru", "te") for b in ("ben", "dor", "fis", "gul", "nat", "pok")]


def _weak_labels(page: list[Block]) -> list[int]:
    """Content by a page's own sectioning elements."""
    out = []
    for b in page:
        tags = [t for t, _, _ in b.path]
        words = {w for _, ws, _ in b.path for w in ws}
        inside = any(t in ("article", "main") for t in tags)
        out.append(int(inside and not ASIDE & set(tags) and not words & set(AWAY)))
    return out


def _layouts(paragraphs: list[str], notes: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page in some common form, and the label of each of its blocks."""
    page, labels = [], []

    def leaf(tag: str, text: str, label: int, attributes: str = ""):
        if text.strip():
            page.append(f"<{tag}{attributes}>{html.escape(text)}</{tag}>")
            labels.append(label)

    invented = rng.random() < 0.5
    plain = ["p", "p", "p", "p", "div", "div", "blockquote", "h2", "h3", "li", "pre", "td"]

    def away(long: bool):
        word = rng.choice(NEUTRAL if invented else AWAY)
        tag = rng.choice(["div", "section", "div", "div", "ul", "table", "aside", "form"])
        attribute = rng.choice(["class", "id"])
        name = word if rng.random() < 0.6 else f"{rng.choice(['site', 'page', 'box', 'main', 'top'])}-{word}"
        page.append(f'<{tag} {attribute}="{name}">')
        linked = rng.choice([0.0, 0.5, 0.9])
        for _ in range(rng.randrange(1, 4)):
            text = rng.choice(paragraphs if long else notes)
            inner = {"ul": "li", "table": "td"}.get(tag) or rng.choice(plain)
            if rng.random() < linked:
                page.append(f'<{inner}><a href="/x">{html.escape(text)}</a></{inner}>')
                if text.strip():
                    labels.append(0)
            else:
                leaf(inner, text, 0)
        page.append(f"</{tag}>")

    def bar(tag: str):
        page.append(f"<{tag}>")
        for _ in range(rng.randrange(1, 5)):
            leaf(rng.choice(plain), rng.choice(notes + paragraphs), 0)
        page.append(f"</{tag}>")

    for tag in ("header", "nav"):
        if rng.random() < 0.4:
            bar(tag)
    for _ in range(rng.randrange(3)):
        away(rng.random() < 0.4)
    tag = rng.choice(["article", "main", "div", "section", "div"])
    home = rng.choice(NEUTRAL if invented else HOME)
    named = f' class="{home}"' if (tag in ("div", "section") and not invented) or rng.random() < 0.5 else ""
    page.append(f"<{tag}{named}>")
    if rng.random() < 0.7:
        leaf("h1", rng.choice(notes), 1)
    for text in paragraphs:
        leaf(rng.choice(plain), text, 1)
        if rng.random() < 0.12:
            away(rng.random() < 0.4)
        if rng.random() < 0.08:
            bar(rng.choice(["aside", "form", "footer", "header"]))
    page.append(f"</{tag}>")
    for _ in range(rng.randrange(4)):
        away(rng.random() < 0.4)
    for tag in ("aside", "footer", "form"):
        if rng.random() < 0.4:
            bar(tag)
    return "<html><body>" + "".join(page) + "</body></html>", labels


def train(pages: list[str], seed: int = 17) -> Field:
    """Fit on the pages themselves and on their texts in other forms."""
    rng = random.Random(seed)
    examples = []
    filler = [" ".join(["word"] * n) + "." for n in (3, 9, 20, 40, 90)]
    for page in [*pages, *[""] * max(0, 200 - len(pages))]:
        read = blocks(page)
        labels = _weak_labels(read)
        if any(labels):
            examples.append((features(read), labels))
        long = [b.text for b, y in zip(read, labels, strict=True) if y][:12] or rng.sample(filler, 3)
        short = [b.text for b, y in zip(read, labels, strict=True) if not y][:12] or filler[:3]
        for _ in range(4):
            made, known = _layouts(long, short, rng)
            again = blocks(made)
            if len(again) == len(known):
                examples.append((features(again), known))
    return Field().fit(examples)


def main_text(page: str, field: Field) -> str:
    read = blocks(page)
    return " ".join(b.text for b, y in zip(read, field.decode(features(read)), strict=True) if y)


def learn(pages: DataFrame, sample: int = SAMPLE, seed: int = 17) -> Field:
    """Fit on the ``sample`` pages whose ids hash lowest; equal rows count once.

    Pages are picked by hashes alone, so no task holds the html of candidates.
    """
    hashed = pages.where(F.length("html") > 0).select(
        "html", F.xxhash64("page_id", F.lit(seed)).alias("place"), F.xxhash64("page_id", "html").alias("key")
    )
    picked = hashed.select("place", "key").distinct().orderBy("place", "key").limit(sample)
    keys = [r["key"] for r in picked.collect()]
    found = hashed.where(F.col("key").isin(keys)).groupBy("key").agg(F.first("html").alias("html"))
    texts = {r["key"]: r["html"] for r in found.collect()}
    return train([texts[k] for k in keys], seed)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(learn(pages, sample))

    def kernel(batches: Batches) -> Batches:
        for batch in batches:
            texts = [main_text(p or "", shared.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1).cast(pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(kernel, "page_id long, url string, text string, n_chars long")
