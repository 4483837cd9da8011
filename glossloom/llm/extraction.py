"""Main text of web pages: a bidirectional recurrent network labels every block with the whole page as context.

Each leaf block is read as a vector of its tag path, its hashed words and some
shares; an LSTM runs over the blocks of a page in both directions and a logistic
unit on both states tells whether the block belongs to the article.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.blocks import NUMBERS, PATHS, WORDS, Block, blocks, numbers, path_features, word_features
from glossloom.llm.common import broadcast
from glossloom.llm.layouts import Layout, pools, weak_labels

#: Pages that training may take, characters of the longest one, and new layouts made of their texts.
PAGES, LONGEST, LAYOUTS = 384, 50_000, 1_200
#: Sizes of the vectors of tags, names and words, and of a state.
TAG, NAME, WORD, STATE = 12, 12, 6, 16
PASSES, BATCH, RATE = 10, 32, 0.008
#: Blocks of a training page that are learned from, and cells (pages x blocks) worked on at once.
STEPS, CELLS = 120, 1 << 15
INPUT = TAG + NAME + WORD + NUMBERS


@dataclass(frozen=True)
class Model:
    tags: np.ndarray  # (PATHS, TAG)
    names: np.ndarray  # (PATHS, NAME)
    words: np.ndarray  # (WORDS, WORD)
    inner: tuple[np.ndarray, np.ndarray]  # (INPUT + STATE + 1, 4 * STATE) of both directions
    last: np.ndarray  # 2 * STATE + 1


class Bags:
    """Features of the blocks of several pages: lists of buckets, joined, with the length of each."""

    def __init__(self, pages: list[list[Block]]):
        both = [path_features(b) for p in pages for b in p]
        words = [word_features(b.text) for p in pages for b in p]
        self.lists = [_joined([x for x, _ in both]), _joined([x for _, x in both]), _joined(words)]
        self.numbers = np.concatenate([numbers(p) for p in pages]) if both else np.zeros((0, NUMBERS), np.float32)
        self.lengths = np.array([len(p) for p in pages])


def _joined(lists) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return (np.concatenate([np.asarray(x, np.int64) for x in lists]) if n.sum() else np.zeros(0, np.int64)), n


def _mean(table: np.ndarray, joined: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean of the vectors of each list, zero for an empty one."""
    flat, n = joined
    out = np.zeros((len(n), table.shape[1]), np.float32)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(table[flat], (np.cumsum(n) - n)[some], axis=0) / n[some][:, None]
    return out


def inputs(m: Model, bags: Bags) -> np.ndarray:
    tables = (m.tags, m.names, m.words)
    return np.concatenate([*(_mean(t, j) for t, j in zip(tables, bags.lists)), bags.numbers], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row (time, page) of each block forwards and backwards: pages are padded at the end in both."""
    page = np.repeat(np.arange(len(lengths)), lengths)
    t = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return t * len(lengths) + page, (np.repeat(lengths, lengths) - 1 - t) * len(lengths) + page


def _run(w: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of an LSTM over x (time, pages, inputs)."""
    steps, n, _ = x.shape
    h, c, out = np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32), np.empty((steps, n, STATE), np.float32)
    given = (x.reshape(steps * n, -1) @ w[:INPUT] + w[-1]).reshape(steps, n, -1)
    inner = w[INPUT:-1]
    for t in range(steps):
        z = given[t] + h @ inner
        gates, g = _sigmoid(z[:, : 3 * STATE]), np.tanh(z[:, 3 * STATE :])
        i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out


def _back(w: np.ndarray, x: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of w, gradient of x) from that of the states."""
    steps, n, _ = x.shape
    dz_all, inner = np.empty((steps, n, 4 * STATE), np.float32), w[INPUT:-1].T
    dh, dc = np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32)
    for t in range(steps - 1, -1, -1):
        _, before, i, f, o, g, tc = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :STATE], dz[:, STATE : 2 * STATE] = dc * g * i * (1 - i), dc * before * f * (1 - f)
        dz[:, 2 * STATE : 3 * STATE], dz[:, 3 * STATE :] = dh * tc * o * (1 - o), dc * i * (1 - g * g)
        dh, dc = dz @ inner, dc * f
    flat = dz_all.reshape(steps * n, -1)
    states = np.concatenate([k[0] for k in kept])
    return np.concatenate([x.reshape(steps * n, -1).T @ flat, states.T @ flat, flat.sum(0, keepdims=True)]), (flat @ w[:INPUT].T).reshape(x.shape)


def _padded(rows: np.ndarray, place: np.ndarray, steps: int, n: int) -> np.ndarray:
    x = np.zeros((steps * n, rows.shape[1]), np.float32)
    x[place] = rows
    return x.reshape(steps, n, -1)


def probabilities(m: Model, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each block, with the blocks of its page before and after it."""
    steps, n = int(lengths.max(initial=0)), len(lengths)
    out = np.full(len(x), m.last[-1], np.float32)
    for k, place in enumerate(_places(lengths)):
        states = _run(m.inner[k], _padded(x, place, steps, n)).reshape(steps * n, STATE)
        out += states[place] @ m.last[k * STATE : (k + 1) * STATE]
    return _sigmoid(out)


def train(pages: list[str], seed: int = 3, layouts: int = LAYOUTS) -> Model:
    """Learns from the pages that mark their article themselves and from layouts made of all pages' texts; the former count three times."""
    rng = np.random.default_rng(seed)
    parsed = [b for b in map(blocks, pages) if b]
    inside, outside = pools(parsed)
    examples = [(b, y) for b in parsed if (y := weak_labels(b)) is not None]
    made = (Layout(rng, inside, outside).page() for _ in range(layouts))
    examples = [(b[:STEPS], y[:STEPS]) for b, y in [*examples * 3, *made] if b]
    # vectors of what training never meets stay near zero and say nothing
    params = [rng.normal(0, scale, s).astype(np.float32) for s, scale in (((PATHS, TAG), 0.5), ((PATHS, NAME), 0.2), ((WORDS, WORD), 0.02))]
    for _ in range(2):
        w = (rng.normal(0, 1, (INPUT + STATE + 1, 4 * STATE)) / np.sqrt(INPUT + STATE)).astype(np.float32)
        w[-1] = 0
        w[-1, STATE : 2 * STATE] = 1
        params.append(w)
    params.append(rng.normal(0, 0.2, 2 * STATE + 1).astype(np.float32))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]))
    batches = [[examples[i] for i in order[k : k + BATCH]] for k in range(0, len(order), BATCH)]
    ready = [(Bags([b for b, _ in batch]), np.concatenate([y for _, y in batch])) for batch in batches]
    step, total = 0, PASSES * len(ready)
    for _ in range(PASSES):
        for at in rng.permutation(len(ready)):
            bags, y = ready[at]
            step += 1
            grads = _gradients(Model(*params[:3], (params[3], params[4]), params[5]), bags, y, rng)
            rate = RATE * (1 - 0.9 * step / total)
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
    return Model(*params[:3], (params[3], params[4]), params[5])


def _gradients(m: Model, bags: Bags, y: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    x, lengths = inputs(m, bags), bags.lengths
    # some pages are read without their names, tags or words, so that each of them is learned
    n, page = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
    mask, at = np.ones((n, INPUT), np.float32), 0
    for width, p in ((TAG, 0.05), (NAME, 0.2), (WORD, 0.5)):
        mask[:, at : at + width] *= (rng.random(n) >= p)[:, None]
        at += width
    x = x * mask[page]
    steps, kept, logits = int(lengths.max()), ([], []), np.full(len(x), m.last[-1], np.float32)
    padded, states, places = [], [], _places(lengths)
    for k, place in enumerate(places):
        padded.append(_padded(x, place, steps, n))
        states.append(_run(m.inner[k], padded[k], kept[k]).reshape(steps * n, STATE))
        logits += states[k][place] @ m.last[k * STATE : (k + 1) * STATE]
    d = ((_sigmoid(logits) - y) / len(y)).astype(np.float32)
    last, dx, inner = [], np.zeros_like(x), []
    for k, place in enumerate(places):
        w = m.last[k * STATE : (k + 1) * STATE]
        last.append(states[k][place].T @ d)
        gw, gx = _back(m.inner[k], padded[k], kept[k], _padded(d[:, None] * w, place, steps, n))
        inner.append(gw)
        dx += gx.reshape(steps * n, -1)[place]
    dx *= mask[page]
    tables, at = [], 0
    for table, (flat, count) in zip((m.tags, m.names, m.words), bags.lists):
        g = np.zeros_like(table)
        each = dx[:, at : at + table.shape[1]] / np.maximum(count, 1)[:, None]
        np.add.at(g, flat, np.repeat(each, count, axis=0))
        tables.append(g)
        at += table.shape[1]
    return [*tables, *inner, np.concatenate([*last, [d.sum()]]).astype(np.float32)]


def chosen(m: Model, pages: list[list[Block]]) -> list[list[Block]]:
    """The blocks of each page that belong to its article; pages are worked on by length, a bounded number of cells at a time."""
    out: list[list[Block]] = [[] for _ in pages]
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        longest, take = len(pages[order[-1]]), []
        while order and (not take or (len(take) + 1) * longest <= CELLS):
            take.append(order.pop())
        bags = Bags([pages[i] for i in take])
        p, at = probabilities(m, inputs(m, bags), bags.lengths), 0
        for i in take:
            out[i] = [b for b, x in zip(pages[i], p[at : at + len(pages[i])]) if x >= 0.5]
            at += len(pages[i])
    return out


def sample(pages: DataFrame, page: str, most: int = PAGES) -> list[str]:
    """At most so many pages of bounded length, the first in an order of hashes; only hashes are sorted."""
    text = F.col(page).cast("string")
    usable = pages.filter(text.isNotNull() & (F.length(text) <= LONGEST))
    order = F.xxhash64(text)
    least = [r["h"] for r in usable.select(order.alias("h")).distinct().orderBy("h").limit(most).collect()]
    rows = usable.filter(order <= F.lit(least[-1])).select(text.alias("t")).distinct().collect() if least else []
    return sorted(r["t"] for r in rows)


def fit(pages: DataFrame, page: str = "html") -> Model:
    return train(sample(pages, page))


def main_text(page: Column, model: Model, spark) -> Column:
    """The text of each page's article, its blocks joined by line ends; empty if there is none."""
    shared = broadcast(spark, model)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in batches:
            out, held, size = [], [], 0
            for t in batch:
                held.append(blocks(t or ""))
                size += len(t or "")
                if size >= 1 << 22:
                    out += chosen(m, held)
                    held, size = [], 0
            out += chosen(m, held)
            yield pd.Series(["\n".join(b.text for b in found) for found in out], dtype=object)

    return extract(page)


def extract_pages(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """keep, text and n_chars (code points of text) of every row.

    Null and empty pages, and those without a block of an article, have an empty
    text. Repeated rows give a row each; null ids and addresses are kept; other
    columns are ignored. Pages of any length are read whole. An empty table gives
    no rows.
    """
    model = model or fit(pages, page)
    found = main_text(F.coalesce(F.col(page).cast("string"), F.lit("")), model, pages.sparkSession)
    return pages.select(*keep, found.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
