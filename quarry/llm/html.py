"""HTML extraction by a recurrent block labeller.

A page is read into leaf blocks: runs of text between block tags, each with the path of
open elements. A block's vector holds hashed parts of its tag path (tags, classes, ids,
roles), hashed words, and a few measures such as its share of link text. A bidirectional
LSTM in numpy reads the blocks of the whole page in both directions and labels each as
article or not; article blocks are the text. Weights are in block_model.npz and come from
`python -m quarry.llm.html_train`, which makes its own pages.
"""

from __future__ import annotations

import html
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

PATH_BITS, WORD_BITS, MEASURES = 256, 96, 12
DIM = PATH_BITS + WORD_BITS + MEASURES
MODEL = os.path.join(os.path.dirname(os.path.abspath(__file__)), "block_model.npz")

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIPPED_TAGS = frozenset("script style noscript template textarea title svg iframe object audio video canvas noframes noembed xmp".split())
#: Those of them that hold no markup: without an end tag they reach to the end of the page.
RAW_TAGS = frozenset("script style textarea title iframe noframes noembed xmp".split())
#: Elements that end where another of the list begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Elements at which an implied end stops looking.
FENCES = frozenset("ul ol menu dl table select article section div main body td th".split())

_TAG = re.compile(r"""<(?:!--(?s:.*?)(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""(?i:\b(class|id|role|itemprop|aria-label))\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _bit(token: str, bits: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % bits


class _Tags(dict):
    """Path bits of a tag with its attributes, remembered."""

    def __missing__(self, key: tuple[str, str]) -> tuple[int, ...]:
        if len(self) > 20_000:
            self.clear()
        tag, attributes = key
        tokens = {"<" + tag}
        for name, *values in _ATTRIBUTE.findall(attributes):
            for part in _PARTS.findall("".join(values)):
                part = part.lower()
                tokens.add(part)
                if len(part) > 4 and part.endswith("s"):
                    tokens.add(part[:-1])
        self[key] = out = tuple({_bit(t, PATH_BITS) for t in tokens})
        return out


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = _bit(word, WORD_BITS)
        return out


_tags, _words = _Tags(), _Words()


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], frozenset[int], float, int]]:
    """Leaf blocks in page order: text, open tags, path bits, share of link text, depth."""
    page = page or ""
    out: list = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    text: list[str] = []
    state = {"links": 0, "open": 0}
    unclosed: set[str] = set()

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                bits = frozenset(b for _, own in stack for b in own)
                out.append((joined, tuple(t for t, _ in stack), bits, min(1.0, state["links"] / len(joined)), len(stack)))
            text.clear()
        state["links"] = 0

    def pop_to(place: int) -> None:
        state["open"] -= sum(t == "a" for t, _ in stack[place:])
        del stack[place:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            text.append(piece)
            if state["open"]:
                state["links"] += len(piece)
        if not m:
            break
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if name in BLOCK_TAGS:
                flush()
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == name:
                    pop_to(place)
                    break
            continue
        if name in SKIPPED_TAGS:
            if name in unclosed or name == "svg" and attributes.endswith("/"):
                continue
            close = re.compile(rf"(?i)</{name}\b[^>]*(?:>|\Z)").search(page, at)
            if close:
                at = close.end()
            elif name in RAW_TAGS:
                at = end
            else:
                unclosed.add(name)
            continue
        if name == "br" or name == "wbr":
            text.append(" " if name == "br" else "")
            continue
        if name in BLOCK_TAGS:
            flush()
            if any(t == "p" for t, _ in stack) and name not in ("button", "label", "select", "option", "optgroup"):
                pop_to(max(k for k, (t, _) in enumerate(stack) if t == "p"))
            if name in ENDED_BY or name in ("tbody", "thead", "tfoot", "optgroup"):
                for place in range(len(stack) - 1, -1, -1):
                    tag = stack[place][0]
                    if name in ENDED_BY.get(tag, ()):
                        pop_to(place)
                    elif tag in FENCES:
                        break
        if name in VOID_TAGS or attributes.endswith("/") and name not in BLOCK_TAGS:
            continue
        stack.append((name, _tags[name, attributes]))
        state["open"] += name == "a"
    flush()
    return out


def vectors(page: list) -> np.ndarray:
    """A row for each block of a page."""
    x = np.zeros((len(page), DIM), np.float32)
    for k, (text, tags, bits, links, depth) in enumerate(page):
        row = x[k]
        row[list(bits)] = 1.0
        words = text.lower().split()
        counts = np.bincount(np.fromiter(map(_words.__getitem__, words), np.int64, len(words)), minlength=WORD_BITS)
        row[PATH_BITS : PATH_BITS + WORD_BITS] = np.log1p(counts) / np.log1p(len(words))
        n = len(text)
        row[PATH_BITS + WORD_BITS :] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, links, depth / 10, (k + 1) / len(page), np.log1p(len(page)) / 5,
            sum(map(text.count, ".,;:!?")) / n * 10, text[-1] in ".!?\u2026\"'", tags[-1:] in (("h1",), ("h2",), ("h3",), ("h4",)) if tags else 0.0,
            sum(map(str.isdigit, text)) / n, "\u00a9" in text or "(c)" in text, any(t in ("li", "td", "th", "option", "button", "label") for t in tags[-3:]),
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_direction(inputs: np.ndarray, lengths: np.ndarray, recurrent: np.ndarray) -> np.ndarray:
    """Hidden states of an LSTM: inputs (rows, steps, 4 * hidden) of rows with descending lengths."""
    rows, steps, _ = inputs.shape
    hidden = recurrent.shape[0]
    h, c = np.zeros((rows, hidden), inputs.dtype), np.zeros((rows, hidden), inputs.dtype)
    out = np.zeros((rows, steps, hidden), inputs.dtype)
    for t in range(steps):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # rows longer than t
        z = inputs[:n, t] + h[:n] @ recurrent
        i, f, o = (_sigmoid(z[:, k * hidden : (k + 1) * hidden]) for k in range(3))
        c[:n] = f * c[:n] + i * np.tanh(z[:, 3 * hidden :])
        h[:n] = o * np.tanh(c[:n])
        out[:n, t] = h[:n]
    return out


def label(pages: list[np.ndarray], weights: dict[str, np.ndarray], group: int = 256) -> list[np.ndarray]:
    """For each page the chance of each block to be article text. Pages of like lengths are run together."""
    out: list = [None] * len(pages)
    order = sorted(range(len(pages)), key=lambda k: -len(pages[k]))
    for a in range(0, len(order), group):
        some = [k for k in order[a : a + group] if len(pages[k])]
        for k in order[a : a + group]:
            if not len(pages[k]):
                out[k] = np.empty(0, np.float32)
        if not some:
            continue
        lengths = np.array([len(pages[k]) for k in some])
        flat = np.concatenate([pages[k] for k in some])
        states = []
        for way in ("f", "b"):
            z = flat @ weights[f"{way}_in"] + weights[f"{way}_bias"]
            x = np.zeros((len(some), lengths[0], z.shape[1]), np.float32)
            for r, (n, e) in enumerate(zip(lengths.tolist(), np.cumsum(lengths).tolist())):
                own = z[e - n : e]
                x[r, :n] = own if way == "f" else own[::-1]
            y = run_direction(x, lengths, weights[f"{way}_rec"])
            states.append([y[r, :n] if way == "f" else y[r, :n][::-1] for r, n in enumerate(lengths.tolist())])
        for r, k in enumerate(some):
            both = np.concatenate((states[0][r], states[1][r]), axis=1)
            out[k] = _sigmoid(both @ weights["out"] + weights["out_bias"]).reshape(-1)
    return out


def load_model(path: str = MODEL) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def texts(pages: list[str | None], weights: dict[str, np.ndarray]) -> list[str]:
    """The article text of each page: its blocks joined by line feeds."""
    read = [blocks(p) for p in pages]
    marks = label([vectors(b) for b in read], weights)
    return ["\n".join(block[0] for block, p in zip(b, m) if p >= 0.5) for b, m in zip(read, marks)]


def extract(pages: DataFrame, html_col: str = "html", model: str = MODEL) -> DataFrame:
    """Each row of pages with its article text as `_text` in place of its html.

    A null or empty page, and one without article blocks, has an empty text. Character
    references are decoded, white space inside a block is one space, blocks are joined by
    one line feed. Truncated and mismatched markup is read as far as it goes. Repeated rows
    are read each; an empty table gives no rows. A column of pages named _text is left out.
    """
    weights = load_model(model)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(texts(batch.tolist(), weights), dtype=object)

    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != html_col and c.lower() != "_text"], text_of(F.col(f"`{html_col}`")).alias("_text"))


def op10_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's article text and its length."""
    done = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


QUERIES = {"op10_block_lstm": op10_block_lstm}
ORACLES: dict[str, str] = {}
