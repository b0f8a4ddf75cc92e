"""Language of every word by a linear-chain conditional random field, and of a document by its words.

A word's score for a language sums the weights of its affixes, character n-grams (hashed) and lexicon entry;
learned transitions tie neighbouring words. Forward-backward gives each word's probabilities, for code-switched text
too. Words are what ``str.split`` gives, in training as in prediction; runs without white space are cut into pieces of at
most ``PIECE`` characters, each a word of the chain, so that scripts without spaces are read whole. Long texts are cut into
blocks of ``BLOCK`` words whose transfer matrices carry the probabilities over the borders, which changes no result.
Training takes a bounded sample of labelled documents (``per_lang`` of every language, of longer texts ``max_chars`` from
the first letter on) and splices their runs into sequences that switch language, so that transitions can be learned.

A document's language is the one with the largest summed probability over its words that have a letter (Unicode category
L); equal sums go to the first by name. ``score`` is that sum's share. Null text, empty text, and text without a letter is
``und`` with score 0. With nothing to learn from (an empty table among it), everything is ``und``. Repeated rows give
repeated results. Texts of any length are read whole. Only key, text and (for training) language are read.
"""

from __future__ import annotations

import functools
import random
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackframe.llm.common import keyed

BITS = 16
UND = "und"
#: Characters of a run without white space that make one word.
PIECE = 40
#: Words of a block of a long text.
BLOCK = 64
#: Bytes of text that a task labels at once, for up to 16 languages.
SLICE = 6_000_000


@functools.cache
def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def has_letter(word: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in word)


def pieces(text: str) -> list[str]:
    """The words of a text, long ones in pieces."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def _hashed(*parts: np.ndarray) -> np.ndarray:
    """Feature numbers of equally long runs of code points; the number of parts tells kinds apart."""
    out, factor = np.full(len(parts[0]), len(parts) * 0x9E3779B1 & 0xFFFFFFFF, np.uint32), 0x85EBCA6B
    for x in parts:
        out += x * np.uint32(factor)
        out ^= out >> np.uint32(15)
        factor = factor * 0xC2B2AE35 + 2 & 0xFFFFFFFF | 1
    out *= np.uint32(0x27D4EB2F)
    return out >> np.uint32(32 - BITS)


class Features:
    """Feature numbers of words: pairs and triples of characters with the word's borders, affixes, the whole word."""

    def __init__(self, words: list[str]):
        text = np.frombuffer("\n".join(["", *words, ""]).lower().encode("utf-32-le"), np.uint32)
        border = np.flatnonzero(text == 10)  # white space stands in no word
        self.start, end = border[:-1], border[1:]
        self.letter = np.logical_or.reduceat(letters()[text], self.start) if len(words) else np.zeros(0, bool)
        self.pairs = _hashed(text[:-1], text[1:])
        self.triples = _hashed(text[:-2], text[1:-1], text[2:]) if len(text) > 2 else text[:0]
        self.inside = text[1:-1] != 10  # a triple over a border belongs to no word
        at = np.arange(len(text) - 1, dtype=np.uint32) - np.repeat(self.start, np.diff(border)).astype(np.uint32)
        whole = np.add.reduceat(_hashed(text[:-1], at, at, at).astype(np.uint32) * np.uint32(0x9E3779B1) + text[:-1], self.start, dtype=np.uint32) if len(words) else text[:0]
        head = [text[np.minimum(self.start + k, end)] for k in range(5)]
        tail = [text[np.maximum(end - k, self.start)] for k in range(5)]
        mark = np.ones(len(words), np.uint32)
        self.once = [_hashed(whole, mark, mark, mark, mark), _hashed(*head[:4], mark), _hashed(*head, mark), _hashed(*tail[:4], mark * 2), _hashed(*tail, mark * 2)]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(words, languages): summed weights; zero for a word without a letter."""
        out = np.empty((len(self.start), weights.shape[1]), np.float32)
        for y in range(weights.shape[1] if len(self.start) else 0):
            w = np.ascontiguousarray(weights[:, y])
            total = np.add.reduceat(w[self.pairs], self.start)
            total += np.add.reduceat(np.append(w[self.triples] * self.inside, np.float32(0)), self.start)
            for f in self.once:
                total += w[f]
            out[:, y] = total
        out[~self.letter] = 0
        return out

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """All features of words with a letter, and the word of each."""
        n = len(self.start)
        owner = np.repeat(np.arange(n), np.diff(np.append(self.start, len(self.pairs))))
        feat = np.concatenate([self.pairs, self.triples[self.inside], *self.once])
        own = np.concatenate([owner, owner[:-1][self.inside], *[np.arange(n)] * len(self.once)])
        kept = self.letter[own]
        return feat[kept].astype(np.int64), own[kept]


class Model:
    def __init__(self, langs: list[str]):
        self.langs, n = langs, len(langs)
        self.weights = np.zeros((1 << BITS, n), np.float32)
        self.moves = np.eye(n, dtype=np.float32) * 2


def forward_backward(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Probabilities of each word's language, for sequences laid end to end, all at once.

    emit: (total words, languages), the exponentials of the words' scores, any scale a word. Sequences are cut into blocks. A
    step handles one place of all blocks, so there are at most ``block`` steps each way, besides one for each border of the longest.
    """
    lengths = np.asarray(lengths, np.int64)
    n = emit.shape[1]
    if not lengths.sum():
        return np.zeros_like(emit)
    go = np.exp(moves - moves.max()).astype(emit.dtype)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    blocks_of = -(-lengths // block)  # an empty sequence has none
    first = np.cumsum(blocks_of) - blocks_of
    place = np.arange(int(blocks_of.sum())) - np.repeat(first, blocks_of)
    starts = np.repeat(np.cumsum(lengths) - lengths, blocks_of) + place * block
    sizes = np.minimum(np.repeat(lengths, blocks_of) - place * block, block)
    # Blocks by size, the longest first; words by place in their block: each step is one slice.
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    at = np.concatenate([starts[:m] + t for t, m in enumerate(alive)])
    cut = np.concatenate([[0], np.cumsum(alive)])
    step = emit[at]
    entry, leave = np.ones((len(starts), n), emit.dtype), np.ones((len(starts), n), emit.dtype)
    many = np.repeat(blocks_of > 1, blocks_of)[order]
    if many.any():
        some = np.flatnonzero(many)
        whole = np.eye(n, dtype=emit.dtype)[None] * step[: len(starts)][some][:, None, :]
        for t in range(1, len(alive)):
            m = int(np.searchsorted(some, alive[t]))  # blocks in order of size, so those still running come first
            new = (whole[:m] @ go) * step[cut[t] : cut[t + 1]][some[:m]][:, None, :]
            whole[:m] = new / new.sum((1, 2), keepdims=True)
        row = np.empty(len(starts), np.int64)
        row[order[some]] = np.arange(len(some))
        seqs = np.flatnonzero(blocks_of > 1)
        seqs = seqs[np.argsort(-blocks_of[seqs], kind="stable")]
        slot = np.empty(len(starts), np.int64)
        slot[order] = np.arange(len(starts))
        for k in range(1, int(blocks_of[seqs[0]])):  # border k: what enters block k
            b = first[seqs[: np.searchsorted(-blocks_of[seqs], -k, "left")]] + k
            come = np.einsum("bi,bij->bj", entry[slot[b - 1]], whole[row[b - 1]])
            entry[slot[b]] = norm(come @ go)
        for k in range(int(blocks_of[seqs[0]]) - 1, 0, -1):
            b = first[seqs[: np.searchsorted(-blocks_of[seqs], -k, "left")]] + k
            back = np.einsum("bij,bj->bi", whole[row[b]], leave[slot[b]])
            leave[slot[b - 1]] = norm(back @ go.T)
    fore = np.empty_like(step)
    state = norm(entry * step[: len(starts)])
    fore[: len(starts)] = state
    for t in range(1, len(alive)):
        state = norm((state[: alive[t]] @ go) * step[cut[t] : cut[t + 1]])
        fore[cut[t] : cut[t + 1]] = state
    for t in range(len(alive) - 1, -1, -1):
        m, here = alive[t], slice(cut[t], cut[t + 1])
        fore[here] *= leave[:m]
        leave[:m] = norm((leave[:m] * step[here]) @ go.T)
    out = np.empty_like(emit)
    out[at] = norm(fore)
    return out


def likelihoods(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(1, keepdims=True, initial=-80)) + np.float32(1e-30)


def teach(rows: list[tuple[str, str]], length: int = 40, sequences: int = 3000, rounds: int = 6, rate: float = 0.3, seed: int = 5) -> Model:
    """Fit on (text, language) rows: sequences spliced from runs of words of one language each."""
    langs = sorted({lang for _, lang in rows})
    model = Model(langs)
    words = {y: [] for y in range(len(langs))}
    place = {lang: y for y, lang in enumerate(langs)}
    for t, lang in rows:
        if t.split():
            words[place[lang]].append(pieces(t))
    if len(langs) < 1 or not all(words.values()):
        return model
    draw = random.Random(seed)
    seqs, tags = [], []
    for _ in range(max(sequences, 40 * len(langs))):
        seq, tag = [], []
        while len(seq) < length:
            y = draw.randrange(len(langs))
            text = draw.choice(words[y])
            run = min(length - len(seq), draw.choice((5, 10, 20, 40)))
            at = draw.randrange(max(1, len(text) - run + 1))
            part = text[at : at + run]
            seq += part
            tag += [y] * len(part)
        seqs.append(seq)
        tags.append(tag)
    kinds = {w: i for i, w in enumerate(sorted({w for s in seqs for w in s}))}
    flat, owner = Features(list(kinds)).listed()
    ids, truth = np.array([[kinds[w] for w in s] for s in seqs]), np.array(tags)
    n = len(langs)
    seen, moves_seen = np.full_like(model.weights, 1e-3), np.full_like(model.moves, 1e-3)
    size = 250
    for r in range(rounds):
        for at in range(0, len(ids), size):
            x, y = ids[at : at + size], truth[at : at + size]
            used, place = np.unique(x, return_inverse=True)
            mask = np.isin(owner, used)
            own, feat = np.searchsorted(used, owner[mask]), flat[mask]
            emit = np.zeros((len(used), n), np.float32)
            np.add.at(emit, own, model.weights[feat])
            scores = likelihoods(emit)[place.reshape(-1)]
            p = forward_backward(scores, np.full(len(x), length), model.moves).reshape(len(x), length, n)
            wrong = np.eye(n, dtype=np.float32)[y] - p
            per_word = np.zeros((len(used), n), np.float32)
            np.add.at(per_word, place.reshape(-1), wrong.reshape(-1, n))
            grad = np.zeros_like(model.weights)
            np.add.at(grad, feat, per_word[own])
            grad -= 0.02 * model.weights
            seen += grad * grad
            model.weights += rate * grad / np.sqrt(seen)
            # Moves: counts seen less counts expected, the latter from neighbouring words' probabilities.
            ahead = scores.reshape(len(x), length, n)[:, 1:].reshape(-1, n)
            here, go = p[:, :-1].reshape(-1, n), np.exp(model.moves)
            joint = go * ((here / np.maximum(((here @ go) * ahead).sum(1, keepdims=True), 1e-30)).T @ ahead)
            counted = np.zeros((n, n), np.float32)
            np.add.at(counted, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
            g = counted - joint
            moves_seen += g * g
            model.moves += 0.1 * rate * g / np.sqrt(moves_seen)
    return model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 150, max_chars: int = 8_000) -> Model:
    """Learn from at most ``per_lang`` documents of each language, lowest key hash first."""
    rows = keyed(docs, key, text, lang).where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    # A hash bound before the ranking keeps a language with most of the rows out of one task.
    counts = F.broadcast(rows.groupBy(lang).count())  # a row a language, each of which has a whole column of weights in the model
    part = F.when(F.length(text) <= max_chars, F.col(text)).otherwise(F.regexp_extract(text, rf"(?s)\p{{L}}.{{0,{max_chars - 1}}}", 0))
    place = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1_000_000))
    near = rows.join(counts, lang).where(place * F.col("count") <= F.lit(3 * per_lang + 60) * 1_000_000).withColumn(text, part)
    some = near.withColumn("_rank", F.row_number().over(Window.partitionBy(lang).orderBy(place, key, text))).where(F.col("_rank") <= per_lang)
    return teach([(r[0], r[1]) for r in some.select(text, lang).orderBy(lang, "_rank").collect()])


def _label(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and share of each text."""
    langs = model.langs
    words = [pieces(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter((i for ws in words for i in map(number.__getitem__, ws)), np.int32, int(lengths.sum()))
    del words
    found = Features(list(number))
    p = forward_backward(likelihoods(found.scores(model.weights))[ids], lengths, model.moves)
    p[~found.letter[ids]] = 0
    some, sums = np.flatnonzero(lengths), np.zeros((len(texts), len(langs)))
    if len(some):
        sums[some] = np.add.reduceat(p, (np.cumsum(lengths) - lengths)[some], axis=0, dtype=np.float64)
    total, top = sums.sum(1), sums.argmax(1)
    share = np.where(total > 0, sums[np.arange(len(texts)), top] / np.maximum(total, 1e-12), 0.0)
    return [langs[t] if s > 0 else UND for t, s in zip(top, total)], np.clip(share, 0, 1)


def runs(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``limit`` characters each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(key, lang_pred, score) of every document; no other column takes part. ``carry``: its row too, as struct ``doc``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights.astype(np.float16), model.moves))  # 65 536 x languages, in halves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights, moves = shared.value
        own = Model(langs)
        own.weights, own.moves = weights.astype(np.float32), moves
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in runs(texts, SLICE * 16 // max(len(langs), 16)):
                best, share = _label(own, texts[i:j]) if langs else ([UND] * (j - i), np.zeros(j - i))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(share, pa.float64()), *part.columns[2:]], names)

    names = [key, "lang_pred", "score"] + ["doc"] * carry
    schema = T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if carry:
        schema.add("doc", docs.schema)
    row = [F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("doc")] if carry else []
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), *row).mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model, least: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that are ``und`` or score below ``least``; all columns stay."""
    names = docs.columns
    return predict(docs, model, key, text, carry=True).where((F.col("lang_pred") != UND) & (F.col("score") >= least)).select(*(F.col(f"doc.`{n}`") for n in names))
