"""HTML extraction by a recurrent block labeller.

A page becomes its sequence of blocks: the runs of text between block-level tags, in page order. Each
block is a vector of its tag path (hashed tag names and class or id words of all ancestors, and of the
nearest two), its hashed words and a few sizes. A bidirectional LSTM in numpy reads the whole sequence
and labels every block as article or not, so a label depends on the whole document. The weights were
trained by `train_blocks.py` on generated pages; they are a model file beside this module.
"""

from __future__ import annotations

import html
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytesop import lower_table, word_hashes, word_table
from .store import small_batches

MODEL = Path(__file__).with_name("blocks_model.npz")
PATH, NEAR, WORDS, SIZES = 96, 32, 16, 8
INPUT = PATH + NEAR + WORDS + SIZES
#: Blocks (times pages) of one padded batch.
BATCH_STEPS = 1 << 14

# Fixed values of HTML: void elements, elements whose text is no page text, block-level elements, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("noscript template textarea title iframe select".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html button label option".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<code>script|style)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=code)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>[/!?a-zA-Z])[^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
_BUCKETS: dict[tuple[str, int], int] = {}


def bucket(token: str, n: int) -> int:
    key = (token, n)
    if key not in _BUCKETS:
        if len(_BUCKETS) > 1 << 16:  # pages invent names without end
            _BUCKETS.clear()
        _BUCKETS[key] = crc32(token.encode()) % n
    return _BUCKETS[key]


@dataclass(slots=True)
class Block:
    text: str
    path: frozenset[int]
    near: tuple[int, ...]
    linked: int
    heading: bool
    in_list: bool


#: Elements that an end tag left out can close, or that keep it from being closed from inside.
MARKS = frozenset(x for kinds in SAME.values() for x in kinds) | SCOPE


@dataclass(slots=True)
class Open:
    """An open element, with what a block needs to know of all elements around it."""

    tag: str
    tokens: tuple[str, ...]
    path: frozenset[int]
    near: tuple[int, ...]
    heading: bool
    in_list: bool
    #: Depths of the nearest element, this one included, that is a paragraph or a block, and that is one of MARKS; -1 for none.
    block: int
    mark: int


OUTSIDE = Open("", (), frozenset(), (), False, False, -1, -1)


def _inside(outer: Open, depth: int, tag: str, tokens: tuple[str, ...]) -> Open:
    new = [bucket(t, PATH) for t in tokens]
    path = outer.path if all(t in outer.path for t in new) else outer.path.union(new)
    near = tuple({bucket("~" + t, NEAR) for t in (*outer.tokens, *tokens)})
    heading, in_list = outer.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), outer.in_list or tag in ("li", "ul", "ol")
    return Open(tag, tokens, path, near, heading, in_list, depth if tag == "p" or tag in BLOCK else outer.block, depth if tag in MARKS else outer.mark)


def blocks(page: str) -> list[Block]:
    """The blocks of a page, texts decoded, with single spaces.

    One pass whose time grows with the page: elements know their surroundings when they open, a closing tag without an
    open element is not looked for, and elements without their end are known by the last end there is.
    """
    out: list[Block] = []
    stack: list[Open] = []
    count: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    last_end: dict[str, int] = {}

    def close(depth: int) -> None:
        for x in stack[depth:]:
            count[x.tag] -= 1
        del stack[depth:]

    def flush() -> None:
        nonlocal parts
        if not parts:
            return
        raw = "".join(x for x, _ in parts)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            linked = sum(len(x) for x, a in parts if a)
            at = stack[-1] if stack else OUTSIDE
            out.append(Block(text, at.path, at.near, min(len(text), linked), at.heading, at.in_list))
        parts = []

    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append((page[at : m.start()], count.get("a", 0) > 0))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
            if count.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW:
            if tag not in last_end:
                last_end[tag] = max((x.start() for x in ENDS[tag].finditer(page)), default=-1)
            if last_end[tag] >= at:
                at = ENDS[tag].search(page, at).end()
                continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and stack and (k := stack[-1].block) >= 0 and stack[k].tag == "p":
                close(k)
            if tag in SAME:
                k = stack[-1].mark if stack else -1
                while k >= 0:
                    if stack[k].tag in SAME[tag]:
                        close(k)
                        if tag != "tr":
                            break
                    elif stack[k].tag in SCOPE:
                        break
                    k = stack[k - 1].mark if k else -1
        if tag in VOID or m["rest"].endswith("/"):
            continue
        names = tuple("." + w for g in NAMES.findall(m["rest"]) for w in WORD.findall("".join(g).lower())) if "=" in m["rest"] else ()
        stack.append(_inside(stack[-1] if stack else OUTSIDE, len(stack), tag, (tag, *names)))
        count[tag] = count.get(tag, 0) + 1
    if at < len(page):
        parts.append((page[at:], count.get("a", 0) > 0))
    flush()
    return out


def vectors(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
    """(one row per block of all pages, bounds of the pages)."""
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    every = [b for p in pages for b in p]
    x = np.zeros((len(every), INPUT), np.float32)
    if not every:
        return x, bounds
    for k, b in enumerate(every):
        x[k, list(b.path)] = 1
        x[k, [PATH + t for t in b.near]] = 1
    raw = [b.text.encode() for b in every]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = lower_table()[np.frombuffer(b"".join(raw), np.uint8)]
    _, _, first, h = word_hashes(data, offsets, word_table("alnum"))
    n = np.diff(first)
    owner = np.repeat(np.arange(len(every)), n)
    bag = np.bincount(owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=len(every) * WORDS).reshape(-1, WORDS)
    x[:, PATH + NEAR : PATH + NEAR + WORDS] = bag / np.sqrt(np.maximum(n, 1))[:, None] / 4
    size = np.array([len(b.text) for b in every], np.float32)
    linked = np.array([b.linked for b in every], np.float32)
    end = np.array([b.text[-1] in ".!?:;\"'”»" for b in every], np.float32)
    page = np.repeat(np.arange(len(pages)), np.diff(bounds))
    nth = np.arange(len(every)) - bounds[page]
    length = np.diff(bounds)[page]
    x[:, -SIZES:] = np.stack([np.log1p(size) / 6, linked / size, end, nth / np.maximum(length - 1, 1), np.log1p(n) / 5, [b.heading for b in every], [b.in_list for b in every], np.ones(len(every))], 1)
    return x, bounds


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.hidden = self.w["uf"].shape[0]

    @classmethod
    def load(cls, data: bytes) -> Labeller:
        with np.load(io.BytesIO(data)) as z:
            return cls({k: z[k] for k in z.files})

    def direction(self, x: np.ndarray, mask: np.ndarray, side: str) -> np.ndarray:
        """Hidden states for (steps, pages, inputs), read forwards; padding leaves the state as it is."""
        w, u, b, hidden = self.w[f"w{side}"], self.w[f"u{side}"], self.w[f"b{side}"], self.hidden
        steps, n, _ = x.shape
        pre = (x.reshape(steps * n, -1) @ w + b).reshape(steps, n, 4 * hidden)
        h = np.zeros((n, hidden), np.float32)
        c = np.zeros((n, hidden), np.float32)
        out = np.zeros((steps, n, hidden), np.float32)
        for t in range(steps):
            z = pre[t] + h @ u
            gate = sigmoid(z[:, : 3 * hidden])
            c2 = gate[:, hidden : 2 * hidden] * c + gate[:, :hidden] * np.tanh(z[:, 3 * hidden :])
            h2 = gate[:, 2 * hidden :] * np.tanh(c2)
            m = mask[t][:, None]
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forward = self.direction(x, mask, "f")
        backward = self.direction(x[::-1], mask[::-1], "b")[::-1]
        both = np.concatenate([forward, backward], 2)
        return sigmoid(both @ self.w["wo"] + self.w["bo"])[..., 0]

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is article text, page by page. Pages of similar length share a padded batch; none is cut."""
        x, bounds = vectors(pages)
        length = np.diff(bounds)
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i + 1) * length[order[j]] <= BATCH_STEPS:
                j += 1
            own = order[i:j]
            steps = int(length[own].max())
            padded = np.zeros((steps, len(own), INPUT), np.float32)
            mask = np.arange(steps)[:, None] < length[own][None, :]
            for k, p in enumerate(own):
                padded[: length[p], k] = x[bounds[p] : bounds[p + 1]]
            s = self.scores(padded, mask)
            for k, p in enumerate(own):
                out[p] = s[: length[p], k] >= 0.5
            i = j
        return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html", model: Path = MODEL) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`: the blocks labelled as article, joined by one space.

    Only scripts and styles, and closed elements that show no text of the page (noscript, template, textarea, title,
    iframe, select), never reach the labeller; what formulas, drawings and objects contain is text of their block.

    Defined cases: a null or empty page has an empty text; a page without tags is one block; unclosed tags
    end with the page; repeated rows each get a row; an empty table gives an empty frame; other columns are
    not read. Pages are labelled whole, some hundred at a time.
    """
    small_batches(pages.sparkSession)
    data = model.read_bytes()
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.load(data)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # slices of bounded size, as blocks take more room than the page
                part, size = [], 0
                while at + len(part) < batch.num_rows and (not part or size < 1 << 20):
                    part.append(batch.column(2)[at + len(part)].as_py() or "")
                    size += len(part[-1])
                found = [blocks(p) for p in part]
                text = [" ".join(b.text for b, y in zip(p, label, strict=True) if y) for p, label in zip(found, labeller.label(found), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                at += len(part)

    return pages.select(F.col(page_id), F.col(url), F.col(html_column)).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
