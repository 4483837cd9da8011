"""Language of words by a linear-chain conditional random field, of texts by the sum of its marginals."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import broadcast, held_out
from glossloom.llm.fit import labelled_sample

#: Languages that can be learned (the most frequent ones), documents of each, stretches of a document, words of a stretch.
LANGUAGES, DOCS, STRETCHES, WORDS = 100, 400, 4, 24
#: Hash buckets of the features and words of a language's lexicon.
BUCKETS, LEXICON = 1 << 17, 2_000
PASSES, BATCH, RATE = 3, 64, 0.3
#: Words labelled as one chain, words held at once, words whose scores a worker keeps.
CHAIN, HELD, CACHED = 64, 131_072, 300_000
#: Characters split into words at once.
BLOCK = 1 << 20
UNKNOWN = "und"
_AROUND = "0123456789.,;:!?\"'()[]{}<>|#$%&*-_/\\"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    lexicon: dict[str, tuple[int, ...]]
    weights: np.ndarray  # (BUCKETS, languages)
    transitions: np.ndarray  # from, to
    start: np.ndarray


def features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Buckets of the word, its prefixes, suffixes, n-grams and lexicon entries; none for a word without letters.

    Affixes have 1 to 4 bytes, n-grams 3. The second argument of crc32 tells the kinds apart.
    """
    if not word.isalpha() and not any(map(str.isalpha, word)):
        return []
    bare = word.strip(_AROUND) or word
    data, crc = bare.encode("utf-8", "surrogatepass"), zlib.crc32
    padded = b" " + data + b" "
    found = [crc(data, 1), crc(data[:1], 2), crc(data[:2], 2), crc(data[:3], 2), crc(data[:4], 2), crc(data[-1:], 3), crc(data[-2:], 3), crc(data[-3:], 3), crc(data[-4:], 3)]
    found += [crc(padded[i : i + 3], 4) for i in range(len(data))]
    found += [crc(b"lexicon", 5 + i) for i in lexicon.get(bare, ())]
    return [f % BUCKETS for f in found]


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward on chains padded to one length: word marginals, scaled forward and backward vectors."""
    n, t, k = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    step, first = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    forward, backward = np.empty((t, n, k)), np.ones((t, n, k))
    a = e[:, 0] * first
    forward[0] = a / a.sum(1, keepdims=True)
    for i in range(1, t):
        a = (forward[i - 1] @ step) * e[:, i]
        forward[i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (backward[i + 1] * e[:, i + 1]) @ step.T
        backward[i] = np.where((i + 1 < lengths)[:, None], b / b.sum(1, keepdims=True), 1.0)
    both = forward * backward
    return (both / both.sum(2, keepdims=True)).transpose(1, 0, 2), forward, backward


def _pair_marginals(scores, lengths, transitions, forward, backward):
    """Summed marginals of neighbouring labels, (from, to)."""
    e = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    total = np.zeros_like(transitions)
    for i in range(1, scores.shape[1]):
        live = i < lengths
        if live.any():
            pair = forward[i - 1][live][:, :, None] * step * (e[live, i] * backward[i][live])[:, None, :]
            total += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return total


def train(rows: list[tuple[str, str]], seed: int = 3) -> Model:
    """Maximum likelihood by Adagrad on stretches of the documents.

    A document's words have its language as label. Half of the chains join
    stretches of two documents, so that changes of language inside a chain occur.
    """
    rng = np.random.default_rng(seed)
    languages = tuple(sorted({v for _, v in rows}))
    k, number = len(languages), {v: i for i, v in enumerate(languages)}
    counts = {v: Counter() for v in languages}
    stretches: list[tuple[list[str], int]] = []
    for text, v in rows:
        words = text[:BLOCK].lower().split()
        counts[v].update({w.strip(".,!?#$%&*|") for w in words})
        for at in rng.integers(0, max(1, len(words) - WORDS + 1), min(STRETCHES, 1 + len(words) // WORDS)):
            stretches.append((words[at : at + WORDS], number[v]))
    listed: dict[str, list[int]] = {}
    for v in languages:
        for w, _ in counts[v].most_common(LEXICON):
            listed.setdefault(w, []).append(number[v])
    lexicon = {w: tuple(x) for w, x in listed.items() if w}
    chains = []
    for i, (words, y) in enumerate(stretches):
        more, z = stretches[rng.integers(len(stretches))] if i % 2 else ([], 0)
        chains.append(([features(w, lexicon) for w in [*words, *more]], [y] * len(words) + [z] * len(more)))
    chains = [c for c in chains if c[0]]
    w, trans, start = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
    gw, gt, gs = np.full((BUCKETS, k), 1e-2), np.full((k, k), 1.0), np.full(k, 1.0)
    for _ in range(PASSES if k else 0):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), BATCH):
            part = [chains[i] for i in order[at : at + BATCH]]
            lengths = np.array([len(x) for x, _ in part])
            t, n = int(lengths.max()), len(part)
            flat = np.array([f for x, _ in part for word in x for f in word], dtype=np.int64)
            where = np.array([i * t + j for i, (x, _) in enumerate(part) for j, word in enumerate(x) for _ in word], dtype=np.int64)
            scores = np.column_stack([np.bincount(where, weights=w[flat, c], minlength=n * t) for c in range(k)]).reshape(n, t, k)
            seen, forward, backward = marginals(scores, lengths, trans, start)
            gold, pairs, first = np.zeros((n, t, k)), np.zeros((k, k)), np.zeros(k)
            for i, (_, labels) in enumerate(part):
                gold[i, np.arange(len(labels)), labels] = 1
                np.add.at(pairs, (labels[:-1], labels[1:]), 1)
                first[labels[0]] += 1
            error = (gold - seen) * (np.arange(t) < lengths[:, None])[:, :, None]
            grad = error.reshape(n * t, k)[where]
            used, inverse = np.unique(flat, return_inverse=True)
            g = np.column_stack([np.bincount(inverse, weights=grad[:, c], minlength=len(used)) for c in range(k)])
            gw[used] += g**2
            w[used] += RATE * g / np.sqrt(gw[used])
            g = pairs - _pair_marginals(scores, lengths, trans, forward, backward)
            gt += g**2
            trans += RATE * g / np.sqrt(gt)
            g = first - seen[:, 0].sum(0)
            gs += g**2
            start += RATE * g / np.sqrt(gs)
    return Model(languages, lexicon, w.astype(np.float32), trans, start)


class _Scores(dict):
    """Word -> row of a table of label scores; the last column tells whether the word has a letter."""

    def __init__(self, model: Model):
        self.model, self.table = model, np.zeros((1 << 12, len(model.languages) + 1))
        self.first, self.pending = 0, []

    def __missing__(self, word: str) -> int:
        self.pending.append(features(word, self.model.lexicon))
        self[word] = i = len(self)
        return i

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of words met so far; the scores of new ones are summed in one go."""
        if self.pending:
            new = len(self.pending)
            while self.first + new > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            sizes = np.fromiter(map(len, self.pending), np.int64, new)
            flat = np.fromiter((f for x in self.pending for f in x), np.int64, int(sizes.sum()))
            rows = self.table[self.first : self.first + new]
            rows[:] = 0.0
            some = np.flatnonzero(sizes)
            if len(some):
                rows[some, :-1] = np.add.reduceat(self.model.weights[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
                rows[some, -1] = 1.0
            self.first += new
            self.pending = []
        return self.table[ids]

    def forget(self) -> None:
        self.clear()
        self.first = 0


def _blocks(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, a bounded stretch of it at a time."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].lower().split()
        at = end


def label_words(words: list[str], model: Model, scores: _Scores | None = None) -> np.ndarray:
    """Marginal of each language for each word of one text; chains of CHAIN words are labelled on their own."""
    scores = _Scores(model) if scores is None else scores
    ids = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
    return _chained(scores.rows(ids)[:, :-1], np.array([len(words)]), model)


def _chained(flat: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Marginals of the words of several texts, one after the other."""
    starts = np.concatenate([np.arange(b, b + s, CHAIN) for b, s in zip(np.cumsum(sizes) - sizes, sizes)] or [np.zeros(0)]).astype(np.int64)
    lengths = np.concatenate([np.minimum(CHAIN, s - np.arange(0, s, CHAIN)) for s in sizes] or [np.zeros(0)]).astype(np.int64)
    if not len(starts):
        return np.zeros((0, flat.shape[1]))
    inside = np.arange(int(lengths.max())) < lengths[:, None]
    at = np.minimum(starts[:, None] + np.arange(inside.shape[1]), len(flat) - 1)
    found, _, _ = marginals(np.where(inside[:, :, None], flat[at], 0.0), lengths, model.transitions, model.start)
    return found[inside]


def predict(texts: list[str | None], model: Model, scores: _Scores) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the language with the largest mean marginal over words with letters."""
    k = len(model.languages)
    if not k:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    votes, letters = np.zeros((len(texts), k)), np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if not held:
            return
        sizes = np.array([len(h) for h in held])
        rows = scores.rows(np.concatenate(held))
        found = _chained(rows[:, :-1], sizes, model) * rows[:, -1:]
        at = np.repeat(owner, sizes)
        for c in range(k):
            votes[:, c] += np.bincount(at, weights=found[:, c], minlength=len(texts))
        letters[:] += np.bincount(at, weights=rows[:, -1], minlength=len(texts))
        held.clear()
        owner.clear()
        if len(scores) > CACHED:
            scores.forget()

    waiting = 0
    for i, text in enumerate(texts):
        for words in _blocks(text or ""):
            for a in range(0, len(words), HELD):
                part = words[a : a + HELD]
                held.append(np.fromiter(map(scores.__getitem__, part), np.int64, len(part)))
                owner.append(i)
                waiting += len(part)
                if waiting >= HELD:
                    flush()
                    waiting = 0
    flush()
    best, known = votes.argmax(1), letters > 0
    score = np.where(known, votes[np.arange(len(texts)), best] / np.maximum(letters, 1), 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.clip(score, 0.0, 1.0)


def language(texts: Column, model: Model, spark) -> Column:
    """Struct (lang, score) of each whole text."""
    shared = broadcast(spark, model)

    @F.pandas_udf("lang string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = _Scores(shared.value)
        for batch in batches:
            lang, score = predict(list(batch), shared.value, scores)
            yield pd.DataFrame({"lang": lang, "score": score})

    return label(texts)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", modulo: int = 4, remainder: int = 2) -> Model:
    learned = ~held_out(doc_id, modulo, remainder)
    common = docs.filter(learned & F.col(lang).isNotNull()).groupBy(lang).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang).limit(LANGUAGES)
    return train(labelled_sample(docs, docs, lang, learned, {r[lang]: DOCS for r in common.collect()}, text, doc_id))


def languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    lang_pred is 'und' with score 0 where the text is null or no word has a letter,
    or where no language could be learned. Ties go to the first language in code
    point order. Repeated rows get equal results; a null id is not held out and
    never used for training. Only text is an input of a prediction; other columns
    are ignored. An empty table gives no rows.
    """
    model = fit(docs, lang, text, doc_id)
    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, 4, 2).alias("held_out"), language(F.col(text), model, docs.sparkSession).alias("_l"))
    return found.select("doc_id", "held_out", F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))
