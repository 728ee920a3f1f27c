"""Main text of web pages: a recurrent labeller reads the leaf blocks of a page in order and keeps the article's.

A page is cut into leaf blocks: text between starts and ends of block elements. A block is read as the sum of vectors
of its tag path (tags, classes, ids and roles, hashed), the mean of vectors of its words (hashed) and a few figures
such as its share of link text. A bidirectional LSTM in numpy runs over all blocks of the page, so that every block is
judged by what stands before and after it, and one logistic unit says whether it belongs to the article. The network is
trained on pages that :func:`practice_page` makes up, by a fixed seed: it depends on no input table.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fernweave.llm.shingles import word_hashes

PATHS, WORDS, PATH_SIZE, WORD_SIZE, FIGURES, HIDDEN = 512, 512, 16, 6, 6, 16

# Elements that start and end blocks, that hold no rendered text, that have no end tag, and that end an open one.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
UNSEEN_TAGS = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea title".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript template svg math".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_OPEN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCK_TAGS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary"}

# quotes hold a value only behind an equals sign
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[a-zA-Z]+")
#: Elements past which an open paragraph and an open item or cell are not looked for.
_SCOPE = BLOCK_TAGS - {"p"}
_HOLDERS = frozenset("ul ol dl table select tbody thead tfoot".split())
#: Elements that a head may hold; any other ends it.
_IN_HEAD = frozenset("head html base link meta title style script noscript template".split())


def _names(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id and role."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return ()
    out = []
    for m in _NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() in ("hidden", "aria-hidden"):
            out += ["hidden"] * (value in ("", "true", "hidden"))
        else:
            out += _PARTS.findall(value)
    return tuple(out)


class _Open:
    """Open elements, with the places of each tag, so that no end tag looks through all of them."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[tuple[frozenset[int], tuple[str, ...], tuple[str, ...]]] = []  # buckets of all, own marks, parent's
        self.at: dict[str, list[int]] = {}
        self.groups: dict[str, tuple[frozenset[str], list[int]]] = {"block": (BLOCK_TAGS, []), "scope": (_SCOPE, []), "holder": (_HOLDERS, [])}
        self.links = self.unseen = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        above, parent, _ = self.paths[-1] if self.paths else (frozenset(), (), ())
        own = frozenset(_bucket(f"{'.' if k else ''}{x}", PATHS) for k, x in enumerate((tag, *names)))
        for tags, places in self.groups.values():
            if tag in tags:
                places.append(len(self.tags))
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.paths.append((above if own <= above else above | own, (tag, *names), parent))
        self.links += tag == "a"
        self.unseen += tag in UNSEEN_TAGS

    def last(self, tag: str, group: str | None) -> int | None:
        """The place of the innermost such element, unless one of the group is open inside it."""
        places = self.at.get(tag)
        if not places or group and self.groups[group][1] and self.groups[group][1][-1] > places[-1]:
            return None
        return places[-1]

    def pop_to(self, k: int | None) -> None:
        while k is not None and len(self.tags) > k:
            tag = self.tags.pop()
            self.paths.pop()
            self.at[tag].pop()
            for tags, places in self.groups.values():
                if tag in tags:
                    places.pop()
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN_TAGS

    def marks(self) -> tuple[int, ...]:
        """Buckets of every tag and name on the path, and those of the last two elements once more as such."""
        above, own, parent = self.paths[-1] if self.paths else (frozenset(), (), ())
        return tuple(sorted(above)) + tuple(sorted({_bucket(f"{depth}:{x}", PATHS) for depth, names in enumerate((own, parent)) for x in names}))


def leaf_blocks(page: str) -> list[tuple[str, tuple[int, ...], int]]:
    """(text, buckets of the tag path, characters of link text) of each leaf block with text, in page order.

    Character references are decoded, white space is one space, text ends are trimmed. Comments, scripts, styles and
    other elements that show no text are left out. Unclosed, left out and stray tags are taken as browsers take them,
    in the main. Time and memory are linear in the page, however deep its elements lie.
    """
    found: list[tuple[str, tuple[int, ...], int]] = []
    stack = _Open()
    pieces: list[str] = []
    linked = at = 0
    n = len(page)

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append((text, stack.marks(), linked))
            pieces.clear()
        linked = 0

    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            if stack.tags and stack.tags[-1] == "head" and not page[at:end].isspace():
                stack.pop_to(len(stack.tags) - 1)  # text ends a head that is still open
            if not stack.unseen:
                piece = page[at:end]
                if "&" in piece:
                    piece = html.unescape(piece)
                pieces.append(piece)
                if stack.links:
                    linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag in BLOCK_TAGS:
                close()
            stack.pop_to(stack.last(tag, None if tag in BLOCK_TAGS else "block"))
            continue
        if tag not in _IN_HEAD:
            stack.pop_to(stack.last("head", None))
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
            if tag in ENDS_P:
                stack.pop_to(stack.last("p", "scope"))
            for other in ENDS_OPEN.get(tag, ()):
                stack.pop_to(stack.last(other, "holder"))
        if tag in VOID_TAGS or m[3].endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in RAW_TAGS:  # no markup inside
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        stack.push(tag, _names(m[3]))
    close()
    return found


# ---------------------------------------------------------------- the network


@lru_cache(maxsize=50_000)
def _bucket(name: str, buckets: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % buckets


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    """Values of bytes for word hashes, either case alike, and which bytes part words: ASCII but letters and digits."""
    value = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
    parts = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
    value[65:91] = value[97:123]
    value[parts] = 0
    return value, parts


_WORD_VALUES, _WORD_PARTS = _word_table()


def _figures(text: str, linked: int) -> tuple[float, ...]:
    n = len(text)
    return (min(1.0, math.log1p(n) / 8), min(1.0, linked / n), min(1.0, (text.count(".") + text.count(",")) / 10), text[-1] in ".!?…", text[0].isupper(), min(1.0, text.count(" ") / 20))


def encode(blocks: list[tuple[str, tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Blocks as arrays: buckets of path marks, how many each block has, the same for words, and figures."""
    paths = [b[1] for b in blocks]
    raw = [b[0].encode("utf-8", "surrogatepass") for b in blocks]
    hashed, starts = word_hashes(np.frombuffer(b" ".join(raw) + b" ", np.uint8), _WORD_VALUES, _WORD_PARTS)
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw]))
    marks = np.fromiter((i for x in paths for i in x), np.int32)
    return marks, np.array([len(x) for x in paths]), (hashed % np.uint64(WORDS)).astype(np.int32), np.diff(bounds), np.array([_figures(b[0], b[2]) for b in blocks], np.float32).reshape(-1, FIGURES)


class Labeller:
    """A bidirectional LSTM over the blocks of a page with a logistic unit on each block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + FIGURES
        self.p: dict[str, np.ndarray] = {"path": rng.normal(0, 0.3, (PATHS, PATH_SIZE)), "word": rng.normal(0, 0.1, (WORDS, WORD_SIZE)), "out": rng.normal(0, 0.3, 2 * HIDDEN + size), "bias": np.zeros(1)}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, size**-0.5, (size, 4 * HIDDEN))
            self.p["h" + side] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.p["c" + side] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, coded: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, tuple]:
        """Vectors of the blocks of encoded pages, and what the gradients of the two tables need."""
        marks, marked, words, worded, figures = (np.concatenate(x) for x in zip(*coded, strict=True))
        sums, tables = [], []
        for flat, counts, name in ((marks, marked, "path"), (words, worded, "word")):
            full = counts > 0
            own = np.zeros((len(counts), self.p[name].shape[1]), np.float32)
            if full.any():
                own[full] = np.add.reduceat(self.p[name][flat], (np.cumsum(counts) - counts)[full])
            scale = (1 / np.maximum(counts, 1) if name == "word" else np.ones(len(counts)))[:, None].astype(np.float32)
            sums.append(own * scale)
            tables.append((flat, counts, scale))
        return np.concatenate([*sums, figures], axis=1), tuple(tables)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states [time, page, HIDDEN] of one direction; x and mask run in that direction."""
        steps, pages = mask.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        z = x @ self.p["x" + side] + self.p["c" + side]
        out = np.empty((steps, pages, HIDDEN), np.float32)
        wh = self.p["h" + side]
        for t in range(steps):
            a = z[t] + h @ wh
            gates = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            live = mask[t][:, None]
            new = np.where(live, f * c + i * g, c)
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((h, c, f, i, o, g, tanh))
            c, h = new, np.where(live, o * tanh, h)
            out[t] = h
        return out

    def _back(self, d: np.ndarray, x: np.ndarray, mask: np.ndarray, side: str, kept: list, grads: dict[str, np.ndarray]) -> np.ndarray:
        steps, pages = mask.shape
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        da = np.empty((steps, pages, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, f, i, o, g, tanh = kept[t]
            live = mask[t][:, None]
            dh = dh + d[t]
            own = np.where(live, dh, 0)
            whole = np.where(live, own * o * (1 - tanh**2) + dc, 0)
            da[t] = np.concatenate([whole * c * f * (1 - f), whole * g * i * (1 - i), own * tanh * o * (1 - o), whole * i * (1 - g**2)], axis=1)
            grads["h" + side] += h.T @ da[t]
            dh = np.where(live, da[t] @ self.p["h" + side].T, dh)
            dc = np.where(live, whole * f, dc)
        grads["x" + side] += np.tensordot(x, da, ([0, 1], [0, 1]))
        grads["c" + side] += da.sum(axis=(0, 1))
        return da @ self.p["x" + side].T

    @staticmethod
    def _laid(x: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of pages one after another as [time, page, size], and which places hold one."""
        mask = np.arange(max(lengths))[:, None] < np.array(lengths)[None]
        laid = np.zeros((*mask.shape, x.shape[1]), np.float32)
        laid.transpose(1, 0, 2)[mask.T] = x
        return laid, mask

    def _turn(self, a: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Each page's places in reverse; padding stays behind."""
        t = np.arange(a.shape[0])[:, None]
        n = np.array(lengths)[None]
        return a[np.where(t < n, n - 1 - t, t), np.arange(a.shape[1])[None]]

    def logits(self, pages: list[tuple[np.ndarray, ...]], labels: list[np.ndarray] | None = None, grads: dict | None = None) -> list[np.ndarray]:
        """A figure for each block of each encoded page, over 0 where it is of the article; with labels also gradients."""
        lengths = [len(p[-1]) for p in pages]
        flat, tables = self.inputs(pages)
        x, mask = self._laid(flat, lengths)
        back = self._turn(x, lengths)
        kept: tuple[list, list] | tuple[None, None] = ([], []) if grads is not None else (None, None)
        hf = self._run(x, mask, "f", kept[0])
        hb = self._turn(self._run(back, mask, "b", kept[1]), lengths)
        all_ = np.concatenate([hf, hb, x], axis=2)
        z = all_ @ self.p["out"] + self.p["bias"]
        if grads is not None and labels is not None:
            y = np.zeros(mask.shape, np.float32)
            y.T[mask.T] = np.concatenate(labels)
            dz = np.where(mask, 1 / (1 + np.exp(-z)) - y, 0).astype(np.float32) / len(flat)
            grads["out"] += np.tensordot(dz, all_, ([0, 1], [0, 1]))
            grads["bias"] += dz.sum()
            d = dz[:, :, None] * self.p["out"]
            dx = d[:, :, 2 * HIDDEN :] + self._back(d[:, :, :HIDDEN], x, mask, "f", kept[0], grads)
            dx = dx + self._turn(self._back(self._turn(d[:, :, HIDDEN : 2 * HIDDEN], lengths), back, mask, "b", kept[1], grads), lengths)
            own = dx.transpose(1, 0, 2)[mask.T]
            for (which, counts, scale), name, cut in zip(tables, ("path", "word"), (slice(0, PATH_SIZE), slice(PATH_SIZE, PATH_SIZE + WORD_SIZE)), strict=True):
                np.add.at(grads[name], which, np.repeat(own[:, cut] * scale, counts, axis=0))
        return [z[:n, k] for k, n in enumerate(lengths)]

    def fit(self, pages: list[tuple[np.ndarray, ...]], labels: list[np.ndarray], rounds: int, rate: float, seed: int) -> None:
        """Adam over shuffled batches of pages."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for turn in range(rounds):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 32):
                some = order[at : at + 32]
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                self.logits([pages[i] for i in some], [labels[i] for i in some], grads)
                step += 1
                now = rate * (1 - 0.9 * turn / rounds)
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)


# ---------------------------------------------------------------- pages to learn from

# Names that pages give to the parts of a page, and what stands in parts that are not the article.
ARTICLE_NAMES = "content post entry story body text main articlebody single detail prose page".split()
OTHER_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar links toc pagination pager tabs".split(),
    "header": "header masthead top site branding logo head banner".split(),
    "footer": "footer bottom copyright legal colophon foot credits".split(),
    "sidebar": "sidebar side widget related aside recommended popular trending rail more".split(),
    "notice": "cookie consent notice alert popup modal gdpr overlay newsletter subscribe paywall banner message".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted banner adsbygoogle dfp".split(),
    "form": "form search login signup subscribe newsletter contact register".split(),
    "comments": "comments comment discussion replies reply thread disqus responses respond feedback".split(),
    "share": "share social sharing tags meta byline author tools actions".split(),
}
PHRASES = "home|about us|contact|privacy policy|terms of use|log in|sign up|subscribe|search|menu|read more|share|accept cookies|all rights reserved|related articles|advertisement|next page|previous|leave a reply|categories|archive|follow us|skip to content|datenschutz|impressum|startseite|kontakt|accueil|mentions légales|connexion|inicio|aviso legal|iniciar sesión|suscríbete|we use cookies to improve your experience|copyright|powered by|download the app".split("|")
SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve la ci sch ung heit ge ver ção mente eau eux ité ando".split()


def practice_page(rng: np.random.Generator) -> tuple[str, dict[str, float]]:
    """A made-up page and, for the text of each of its blocks, whether it is of the article."""
    truth: dict[str, float] = {}

    def chance(p: float) -> bool:
        return rng.random() < p

    def some(options):
        return options[int(rng.integers(len(options)))]

    def words(n: int) -> str:
        out = ["".join(some(SYLLABLES) for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]
        for i in range(n):
            if chance(0.08):
                out[i] += some(".,")
        return " ".join(out)

    def said(label: float, n: int, ends: bool = True) -> str:
        text = words(n)
        text = (text[0].upper() + text[1:] if chance(0.8) else text) + (some(".!?.") if ends and chance(0.9) else "")
        if not label and chance(0.4):
            text = f"{some(PHRASES)} {text}" if chance(0.5) else some(PHRASES) + f" {int(rng.integers(1 << 30))}"
        truth.setdefault(text, label)
        return text

    def named(names: list[str]) -> str:
        kind = rng.random()
        name = some(names) if chance(0.7) else f"{some(['site', 'main', 'js', 'block', 'c'])}-{some(names)}"
        return f' class="{name}"' if kind < 0.6 else f' id="{name}"' if kind < 0.8 else f' class="box {name}"'

    def bare(p: float, names: list[str]) -> str:
        return "" if chance(p) else named(names)

    def menu() -> str:
        items = "".join(f'<li><a href="#">{said(0, int(rng.integers(1, 4)), False)}</a></li>' for _ in range(int(rng.integers(2, 9))))
        body = f"<ul>{items}</ul>"
        return f"<nav{bare(0.6, OTHER_NAMES['menu'])}>{body}</nav>" if chance(0.7) else f"<div{named(OTHER_NAMES['menu'])}>{body}</div>"

    def other(kind: str) -> str:
        tags = {"header": ["header"], "footer": ["footer"], "sidebar": ["aside"], "form": ["form"], "notice": ["div", "section", "dialog"], "advert": ["div", "aside", "section"], "comments": ["section", "div"], "share": ["div", "ul"]}[kind]
        own = kind in ("header", "footer", "sidebar", "form")
        tag, mark = (some(tags), bare(0.6, OTHER_NAMES[kind])) if own and chance(0.7) else (some(["div", "section"]), named(OTHER_NAMES[kind]))
        n = int(rng.integers(1, 7 if kind == "comments" else 4))
        inside = []
        for _ in range(n):
            text = said(0, int(rng.integers(1, 60 if kind in ("comments", "advert", "sidebar", "notice", "footer") else 8)))
            wrap = some(["p", "div", "li", "span", "a", "h3", "button", "label", ""])
            inside.append(f"<{wrap}>{text}</{wrap}>" if wrap in ("p", "div", "li", "h3") else f"<p><{wrap}>{text}</{wrap}></p>" if wrap and n > 1 else f"<div>{text}</div>" if n > 1 else text)
        if kind == "header" and chance(0.5):
            inside.append(menu())
        return f"<{tag}{mark}>{''.join(inside)}</{tag}>"

    def article() -> str:
        parts = []
        if chance(0.85):
            parts.append(f"<h1>{said(1, int(rng.integers(2, 14)), chance(0.5))}</h1>")
        for _ in range(int(rng.integers(1, 16))):
            roll = rng.random()
            text = said(1, int(rng.integers(1, 120)) if chance(0.7) else int(rng.integers(1, 8)))
            if roll < 0.72:
                parts.append(some([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p><em>{text}</em></p>", f"<p>{text}</p>", f"<p><a href='#'>{text}</a></p>"]))
            elif roll < 0.8:
                parts.append(f"<h{int(rng.integers(2, 5))}>{text}</h2>")
            elif roll < 0.88:
                parts.append(f"<ul><li>{text}</li><li>{said(1, 9)}</li></ul>")
            elif roll < 0.93:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif roll < 0.96:
                parts.append(f"<table><tr><td>{text}</td><td>{said(1, 3)}</td></tr></table>")
            else:
                parts.append(f"<div>{text}</div>")
            if chance(0.06):
                parts.append(other(some(["advert", "sidebar", "share", "notice", "form"])))
        if chance(0.15):
            parts.append(other("comments"))
        roll = rng.random()
        body = "".join(parts)
        if roll < 0.45:
            return f"<article{bare(0.7, ARTICLE_NAMES)}>{body}</article>"
        if roll < 0.65:
            return f"<main{bare(0.7, ARTICLE_NAMES)}>{body}</main>"
        if roll < 0.75:
            return f"<main><article>{body}</article></main>"
        return f"<{some(['div', 'section'])}{bare(0.15, ARTICLE_NAMES)}>{body}</{'div'}>"

    before = [f() for f, p in ((lambda: other("notice"), 0.2), (lambda: other("header"), 0.5), (menu, 0.75), (lambda: other("advert"), 0.5), (lambda: other("form"), 0.15), (lambda: other("sidebar"), 0.2)) if chance(p)]
    after = [f() for f, p in ((lambda: other("share"), 0.2), (lambda: other("advert"), 0.2), (lambda: other("comments"), 0.3), (lambda: other("sidebar"), 0.4), (lambda: other("form"), 0.15), (lambda: other("notice"), 0.1), (lambda: other("footer"), 0.85)) if chance(p)]
    inner = "".join([*before, article(), *after])
    if chance(0.3):
        inner = f'<div class="{some(["wrapper", "container", "page", "layout"])}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{inner}</body></html>", truth


_trained: dict[tuple, Labeller] = {}


def trained_labeller(pages: int = 1000, rounds: int = 8, seed: int = 11) -> Labeller:
    """The labeller, trained on made-up pages; once in a process. The same seed gives the same network."""
    key = pages, rounds, seed
    if key not in _trained:
        rng = np.random.default_rng(seed)
        blocks, labels = [], []
        for _ in range(pages):
            page, truth = practice_page(rng)
            own = leaf_blocks(page)
            blocks.append(encode(own))
            labels.append(np.array([truth.get(b[0], 0.0) for b in own], np.float32))
        model = Labeller(seed)
        model.fit(blocks, labels, rounds, 0.01, seed)
        _trained[key] = model
    return _trained[key]


def extract_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """The article text of each page, its blocks joined by line ends; pages of similar length run together."""
    blocks = [leaf_blocks(p or "") for p in pages]
    order = sorted((k for k, b in enumerate(blocks) if b), key=lambda k: len(blocks[k]))
    texts = [""] * len(pages)
    group: list[int] = []

    def run() -> None:
        for k, z in zip(group, model.logits([coded.pop(k) for k in group]), strict=True):
            texts[k] = "\n".join(b[0] for b, keep in zip(blocks[k], z > 0, strict=True) if keep)
        group.clear()

    coded = {k: encode(blocks[k]) for k in order}
    for k in order:
        if group and (len(group) >= 256 or len(blocks[k]) * (len(group) + 1) > 16_384 or len(blocks[k]) > 1.3 * len(blocks[group[0]]) + 4):
            run()
        group.append(k)
    if group:
        run()
    return texts


def main_texts(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: id, url, text and n_chars (code points), a row for each row of ``pages``.

    Null and empty pages, and pages without an article, have an empty text. Pages of any length are read whole; null
    ids and urls stay null; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_labeller())  # a few 10,000 numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract_texts(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return pages.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{url_col}` as string) url", f"`{html_col}` html_").mapInArrow(extract, "id long, url string, text string, n_chars long")
