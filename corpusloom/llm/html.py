"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that break a block, that have no content, whose content is left out as no text of the page, and those
# that end where one of the same kind (or of the listed ones) begins.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noembed noframes".split())
#: Its content is text as it stands.
PLAIN = "xmp"
CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"}.items()}
SCOPES = frozenset("ul ol menu dl table body article section div main aside".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*+>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]{2,}")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Block:
    """Text of a run of inline content, how much of it is links, the node it lies in, and the columns it has beside those of the node's path."""

    text: str
    linked: int
    node: int
    own: tuple[int, ...]


@dataclass
class Page:
    """Blocks in page order. A node is known by its parent and the columns that it adds to its parent's path, so a page's size bounds all of them, however deep it nests."""

    blocks: list[Block]
    parents: list[int]
    fresh: list[tuple[int, ...]]


class _Path:
    """The open elements, outermost first. Where a name stood last and where the innermost scope begins is kept, so that no tag walks over all of them."""

    def __init__(self):
        self.open: list[tuple[str, tuple[str, ...], tuple[int, ...], int]] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []
        self.held: Counter[int] = Counter()
        self.parents, self.fresh = [-1], [()]

    def push(self, name: str, marks: tuple[str, ...]) -> None:
        columns = tuple({_column(f"in {name}"), *(_column(f"mark {w}") for w in marks)})
        self.parents.append(self.node)
        self.fresh.append(tuple(c for c in columns if not self.held[c]))
        self.held.update(columns)
        self.at[name].append(len(self.open))
        if name in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append((name, marks, columns, len(self.parents) - 1))

    def cut(self, k: int) -> None:
        """Close the k-th element and all inside it."""
        while len(self.open) > k:
            name, _, columns, _ = self.open.pop()
            self.held.subtract(columns)
            self.at[name].pop()
            if name in SCOPES:
                self.scopes.pop()

    @property
    def node(self) -> int:
        return self.open[-1][3] if self.open else 0

    @property
    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else -1

    def last(self, name: str) -> int:
        return places[-1] if (places := self.at[name]) else -1

    def leaf_columns(self) -> set[int]:
        names = [t for t, *_ in self.open[-2:]]
        found = [f"leaf {t}" for t in names[-1:]] + [f"up {t}" for t in names[:-1]] + [f"leaf mark {w}" for _, marks, *_ in self.open[-2:] for w in marks]
        return {_column(n) for n in found}


def leaf_blocks(page: str | None) -> Page:
    """The blocks of a page that hold text, in page order.

    Character references are decoded, white space is one blank; comments, scripts, the title and other raw content are left out. Open
    paragraphs and list items end where HTML ends them, stray end tags are passed over. Time and memory grow with the page, not with its depth.
    """
    page = page or ""
    blocks: list[Block] = []
    path = _Path()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                linked = min(linked, len(text))
                own = path.leaf_columns() | text_columns(text, linked)
                blocks.append(Block(text, linked, path.node, tuple(c for c in own if not path.held[c])))
            parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        found = _MARKUP.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            parts.append(page[at:stop])
            if path.at["a"]:
                linked += stop - at
        if not found:
            break
        at = found.end()
        mark = found[0]
        if mark[1] in "!?":
            if mark.startswith("<![CDATA["):
                parts.append(mark[9:-3])
            continue
        name = _NAME.match(mark)[1].lower()
        if mark[1] == "/":
            if name in BLOCK:
                flush()
            k = path.last(name)
            if k >= 0 and (name in BLOCK or k >= path.scope):
                path.cut(k)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            if not mark.endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == PLAIN:
            flush()
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            parts.append(page[at : end.start() if end else len(page)].replace("&", "&amp;"))
            linked += len(parts[-1]) if path.at["a"] else 0
            flush()
            at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            flush()
            k = max(map(path.last, ("p", *CLOSES.get(name, ()))))
            if k >= 0 and k >= path.scope:
                path.cut(k)
        if name not in VOID and not mark.endswith("/>"):
            marks = tuple(w for a in _MARKS.findall(mark) for w in _WORDS.findall(_CAMEL.sub(r"\1 \2", "".join(a)).lower()))
            path.push(name, marks)
    flush()
    return Page(blocks, path.parents, path.fresh)


# --- features --------------------------------------------------------------------------------

#: Features are hashed to this many columns.
BITS = 15


@lru_cache(maxsize=200_000)
def _column(feature: str) -> int:
    h = 0xCBF29CE484222325
    for b in feature.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 31) & ((1 << BITS) - 1)


def text_columns(text: str, linked: int) -> set[int]:
    """What a block's text looks like, whatever its length; single words are no features."""
    n = text.count(" ") + 1
    own = [f"words {min(n.bit_length(), 7)}", f"links {min(3, int(4 * linked / len(text)))}", f"stop {text[-1] in '.!?…:;'}", f"digits {any(c.isdigit() for c in text)}"]
    own.append(f"commas {min(2, text.count(','))}")
    own += [f"sign {c}" for c in "©»→✕" if c in text]
    return set(map(_column, own))


def features(page: Page) -> list[tuple[int, ...]]:
    """Columns of each block: its ancestors' tags and names, and what its text looks like. For pages to learn from, whose depth is small."""
    out = []
    for b in page.blocks:
        row, node = list(b.own), b.node
        while node >= 0:
            row += page.fresh[node]
            node = page.parents[node]
        out.append(tuple(row))
    return out


# --- the model -------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of (feature, label) and of (label, label), with labels 0 (other) and 1 (main text)."""

    state: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def scores(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        return np.array([self.state[list(r)].sum(axis=0) for r in rows])

    def page_scores(self, page: Page) -> list[list[float]]:
        """Each block's two scores: a path's sum is its parent's and what its own columns add."""
        sums = np.zeros((len(page.parents), 2))
        for k, (parent, fresh) in enumerate(zip(page.parents, page.fresh, strict=True)):
            if parent >= 0:
                sums[k] = sums[parent] + self.state[list(fresh)].sum(axis=0) if fresh else sums[parent]
        return [(sums[b.node] + self.state[list(b.own)].sum(axis=0)).tolist() for b in page.blocks]

    def labels(self, page: Page) -> list[int]:
        """The likeliest labels of a page's blocks."""
        return self.decoded(self.page_scores(page))

    def viterbi(self, rows: list[tuple[int, ...]]) -> list[int]:
        """The likeliest labels of blocks given by their columns."""
        return self.decoded(self.scores(rows).tolist())

    def decoded(self, scores: list[list[float]]) -> list[int]:
        if not scores:
            return []
        (a, b), (c, d) = self.step.tolist()
        x, y = scores[0][0] + float(self.first[0]), scores[0][1] + float(self.first[1])
        back = []
        for s0, s1 in scores[1:]:
            back.append((int(y + c > x + a), int(y + d > x + b)))
            x, y = max(x + a, y + c) + s0, max(x + b, y + d) + s1
        labels = [int(y > x)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def _marginals(scores: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label and of each pair of neighbouring labels, by forward and backward sums."""
    n = len(scores)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = scores[0] + first
    for t in range(1, n):
        forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + step, axis=0) + scores[t]
    for t in range(n - 2, -1, -1):
        backward[t] = np.logaddexp.reduce(step + (scores[t + 1] + backward[t + 1])[None, :], axis=1)
    total = np.logaddexp.reduce(forward[-1])
    pairs = np.exp(forward[:-1, :, None] + step[None] + (scores[1:] + backward[1:])[:, None, :] - total)
    return np.exp(forward + backward - total), pairs


def fit(pages: list[tuple[list[tuple[int, ...]], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-5, seed: int = 5) -> Model:
    """Maximum likelihood by adaptive gradient steps, page by page."""
    model = Model(np.zeros((1 << BITS, 2)), np.zeros((2, 2)), np.zeros(2))
    seen = [np.full_like(x, 1e-6) for x in (model.state, model.step, model.first)]
    rng = random.Random(seed)
    pages = [p for p in pages if p[0]]
    for _ in range(epochs):
        rng.shuffle(pages)
        for rows, labels in pages:
            scores = model.scores(rows)
            single, pairs = _marginals(scores, model.step, model.first)
            truth = np.eye(2)[labels]
            gradient = truth - single
            sizes = [len(r) for r in rows]
            columns = np.fromiter((c for r in rows for c in r), dtype=np.int64, count=sum(sizes))
            sums = np.zeros((len(columns), 2))
            sums[:] = np.repeat(gradient, sizes, axis=0)
            touched, where = np.unique(columns, return_inverse=True)
            g = np.zeros((len(touched), 2))
            np.add.at(g, where, sums)
            g -= decay * model.state[touched]
            seen[0][touched] += g**2
            model.state[touched] += rate * g / np.sqrt(seen[0][touched])
            for k, (weights, g) in enumerate(((model.step, np.einsum("ti,tj->ij", truth[:-1], truth[1:]) - pairs.sum(axis=0)), (model.first, gradient[0])), 1):
                seen[k] += g**2
                weights += rate * g / np.sqrt(seen[k])
    return model


# --- labelled pages --------------------------------------------------------------------------

# How sites name what is not their article, and what they write there.
OTHER = {
    "nav": ("menu navigation navbar nav topnav breadcrumb breadcrumbs skip toc pagination", "Home About Contact News Archive Next Previous Login Search Menu"),
    "header": ("header masthead banner site-header logo tagline topbar", "Welcome to our site|The daily page|Sign in|Subscribe now"),
    "footer": ("footer site-footer copyright legal colophon bottom", "© all rights reserved|Privacy policy|Terms of use|Imprint|Contact us"),
    "aside": ("sidebar aside related recommended widget promo popular trending teaser", "Related articles|Most read|You may also like|Read more"),
    "notice": ("cookie cookie-banner consent notice gdpr alert popup modal newsletter overlay paywall", "We use cookies to improve this site|Accept all|By going on you agree|Subscribe to our newsletter"),
    "ad": ("ad ads advert advertisement sponsored sponsor adsbygoogle commercial banner-ad", "Advertisement|Sponsored content|Buy now and save|Limited offer|Click here"),
    "form": ("form search-form login signup contact-form subscribe", "Your email|Your name|Send|Search|Submit"),
    "comments": ("comments comment comment-list reader-comments discussion disqus replies responses comment-body", "Reply|Great post thanks for sharing|I do not agree with this|Report|says"),
    "share": ("share social sharing buttons follow social-links", "Share on|Tweet|Like|Follow us|Print"),
}
MAIN = ("article main", "content post entry article-body story main-content text body-text post-content entry-content story-body page-content")


def _prose(rng: random.Random, words: int) -> str:
    syllables = "an be co de er fa gi ho in ka le mo na or pe qu ra st ti un ve wa éa ü ñi sch".split()
    common = "the and of to in a is it you your we our this that on for with more all no at from as by read use site contact post share".split()
    out = [rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    for k in range(0, len(out), rng.randint(6, 15)):
        out[k] = out[k].capitalize()
        if k:
            out[k - 1] += rng.choice(".,.;")
    return " ".join(out) + rng.choice(["", ".", "."])


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of a random layout, and the label of each of its blocks."""
    labels: list[int] = []

    def text(label: int, words: tuple[int, int], phrases: str = "") -> str:
        labels.append(label)
        if phrases and rng.random() < 0.5:
            return rng.choice(phrases.split("|")) if "|" in phrases else " ".join(rng.sample(phrases.split(), 1))
        return _prose(rng, rng.randint(*words))

    def named(names: str, odds: float = 0.7) -> str:
        return rng.choice([f' class="{rng.choice(names.split())}"', f' id="{rng.choice(names.split())}"']) if rng.random() < odds else ""

    def other(kind: str) -> str:
        names, phrases = OTHER[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        proper = tag is not None and rng.random() < 0.7
        tag = tag if proper else rng.choice(["div", "section", "ul"] if kind in ("nav", "share") else ["div", "section", "aside"] if kind in ("notice", "ad", "share") else ["div", "section"])
        inside = []
        if kind in ("nav", "share") or tag == "ul":
            item = lambda: f'<li><a href="#">{text(0, (1, 3), phrases)}</a></li>'
            inside = ["".join(item() for _ in range(rng.randint(2, 8)))]
            inside = inside if tag == "ul" else ["<ul>", *inside, "</ul>"]
        elif kind == "form":
            inside = [f"<label><p>{text(0, (1, 3), phrases)}</p></label><input name=q><button>{text(0, (1, 2), phrases)}</button>"]
        elif kind == "comments":
            for _ in range(rng.randint(1, 5)):
                inside.append(f"<div{named(names, 0.5)}><p>{text(0, (4, 60), phrases)}</p></div>")
            if rng.random() < 0.5:
                inside.insert(0, "")
        elif kind == "aside":
            for _ in range(rng.randint(1, 4)):
                inside.append(rng.choice(["<p>{}</p>", '<p><a href="#">{}</a></p>', '<div><a href="#">{}</a></div>']).format(text(0, (2, 25), phrases)))
        else:
            for _ in range(rng.randint(1, 3)):
                inside.append(rng.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(text(0, (2, 30), phrases)) if rng.random() < 0.6 else f"<p>{text(0, (2, 12), phrases)}</p>")
            inside = [f"<p>{x}</p>" if not x.startswith("<") and len(inside) > 1 else x for x in inside]
        return f"<{tag}{named(names, 0.5 if proper else 1.0)}>{''.join(inside)}</{tag}>"

    def body() -> str:
        tag = rng.choice(["article", "article", "main", "div", "section"])
        out = [f"<h1>{text(1, (2, 12))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(2, 12)):
            kind = rng.random()
            if kind < 0.75:
                out.append(f"<p>{'<b>' * (rng.random() < 0.2)}{text(1, (1, 90))}</p>")
            elif kind < 0.85:
                out.append(f"<h2>{text(1, (1, 8))}</h2>")
            elif kind < 0.93:
                out.append("<ul>" + "".join(f"<li>{text(1, (1, 20))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            else:
                out.append(f"<blockquote>{text(1, (5, 40))}</blockquote>")
            if rng.random() < 0.06:
                out.append(other(rng.choice(["ad", "aside", "share", "notice", "form"])))
        if rng.random() < 0.1:
            out.append(other("comments"))
        return f"<{tag}{named(MAIN[1], 0.4 if tag in MAIN[0] else 1.0)}>{''.join(out)}</{tag}>"

    out = ["<html><body>"]
    out += [other(k) for k in ("header", "nav") if rng.random() < 0.7]
    out += [other(k) for k in ("notice", "ad", "aside", "form") if rng.random() < 0.3]
    out.append(body())
    out += [other(k) for k in ("share", "comments", "aside", "ad", "form", "footer", "notice") if rng.random() < 0.45]
    return "".join(out) + "</body></html>", labels


@lru_cache(maxsize=2)
def trained(pages: int = 600, seed: int = 23) -> Model:
    """The model of so many labelled pages of random layouts; the same one in every run."""
    rng = random.Random(seed)
    examples = []
    while len(examples) < pages:
        page, labels = labelled_page(rng)
        found = leaf_blocks(page)
        if len(found.blocks) == len(labels):
            examples.append((features(found), labels))
    return fit(examples)


def main_text(page: str | None, model: Model) -> str:
    """The blocks that the model takes for main text, two line ends between them."""
    found = leaf_blocks(page)
    return "\n\n".join(b.text for b, y in zip(found.blocks, model.labels(found), strict=True) if y)


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text``: the main text of each whole page.

    Pages are cut into leaf blocks (runs of inline content between block elements); a linear-chain conditional random
    field labels a page's blocks by ancestor-tag and text features, its labels are decoded by Viterbi, and blocks of main
    text are joined in page order. One pass without a shuffle; the model is trained once, on the driver, on a fixed number
    of labelled pages of many layouts, and has a fixed size.

    A null page is an empty one, whose text is empty. Rows count one by one. No rows give no rows. Time and memory of a page grow with its length,
    also where thousands of elements are left open; of two labellings of equal score the one with fewer blocks of main text counts.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or trained())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py(), held.value) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
