"""Ids of two public tokenizers over batches of texts, each distinct word of a batch encoded once.

A text whose words stand between single spaces, with no other white space beside a space or at its ends, can be cut at them: the
byte-level pattern starts a new match at such a space, and no piece of the other vocabulary has a space after another character. Distinct
words are encoded together and spread over their places. Every other text is encoded as a whole. Paths of the vocabulary
files are parameters; without one a worker asks the installed package for its own place of the file.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

#: White space by either tokenizer or Python.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts that are not cut at spaces.
WHOLE = rf"^{SPACE}|{SPACE}$| {SPACE}|{SPACE} |^$"
#: Distinct words that the piece encoder takes in one line.
LINE = 20


def place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spread(index: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each word at its places, one after another, and how many each place has."""
    starts = np.cumsum(counts) - counts
    n = counts[index]
    before = np.cumsum(n) - n
    return ids[np.repeat(starts[index] - before, n) + np.arange(n.sum())], n


class Words:
    """The texts of a batch that are cut: which they are, their distinct words, and each place's word."""

    def __init__(self, texts: pa.Array, odd: str = WHOLE):
        uncut = pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False)
        self.whole, self.cut = np.flatnonzero(uncut).tolist(), np.flatnonzero(~uncut)
        lists = pc.split_pattern(texts.take(pa.array(self.cut)), " ")
        self.offsets = np.asarray(lists.offsets).astype(np.int64)
        self.words = lists.flatten().dictionary_encode()
        self.index, self.distinct = self.words.indices.to_numpy().astype(np.int64), self.words.dictionary
        self.sizes = pc.binary_length(self.distinct).to_numpy().astype(np.int64) + 1  # in bytes, with the space

    def ids(self, out: list[np.ndarray], ids: np.ndarray, counts: np.ndarray, first: Callable[[str], np.ndarray] | None = None) -> list[np.ndarray]:
        """Put the ids of the cut texts into ``out``, given those of the distinct words; ``first`` gives those of a text's first word if that has no space."""
        index = self.index
        if not len(self.cut):
            return out
        if first:
            heads = self.words.dictionary.take(self.words.indices.take(pa.array(self.offsets[:-1]))).dictionary_encode()
            each = [first(w) for w in heads.dictionary.to_pylist()]
            index = index.copy()
            index[self.offsets[:-1]] = len(counts) + heads.indices.to_numpy()
            ids, counts = np.concatenate([ids, *each]), np.concatenate([counts, [len(x) for x in each]])
        ids, n = spread(index, ids, counts)
        bounds = np.concatenate([[0], np.cumsum(n)])[self.offsets].tolist()
        for i, a, b in zip(self.cut.tolist(), bounds, bounds[1:]):
            out[i] = ids[a:b]
        return out


def joined(words: pa.Array, width: int) -> list[str]:
    """``width`` words at a time, a space between them."""
    offsets = pa.array([*range(0, len(words), width), len(words)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ").to_pylist() if len(words) else []


def counted(lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many tokens of the given lengths each word of the given sizes has, token and word ends agreeing."""
    return np.diff(np.searchsorted(np.cumsum(lengths), np.cumsum(sizes), "right"), prepend=0)


class ByteLevel:
    """Byte-level BPE: ids of the JSON file's tokenizer, by a faster encoder over the same vocabulary's ranks.

    A text that holds a special token's string goes through the tokenizer of the JSON file itself.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None, pattern: str | None = None):
        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        with open(ranks or place("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path or place("byte_bpe_50k.json"))
        special = [str(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([WHOLE, *(rf"\Q{s}\E" for s in special)])
        self.special = special
        self.size = self.tokenizer.get_vocab_size()
        self.lengths = np.zeros(self.size, np.int64)
        for w, i in table.items():
            self.lengths[i] = len(w)

    def plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.plain(text)

    def words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        ids = self.plain(" " + joined(words.distinct, len(words.distinct))[0]) if len(words.distinct) else np.zeros(0, np.uint32)
        return ids, counted(self.lengths[ids], words.sizes)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as the tokenizer gives them by default, without special tokens added."""
        words, out = Words(texts, self.odd), [np.zeros(0, np.uint32)] * len(texts)
        for i in words.whole:
            out[i] = self._whole(texts[i].as_py())
        return words.ids(out, *self.words(words), self.plain)


class Pair:
    """Both tokenizers over " " + text, special tokens' strings being plain text. A text without tokens by either has none by both."""

    def __init__(self, ranks: str | None = None, pieces: str | None = None, pattern: str | None = None):
        self.a = ByteLevel(None, ranks, pattern)
        self.b = SentencePieceProcessor(model_file=pieces or place("piece_bpe_32k.model"))
        texts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)]
        self.b_lengths = np.array([len(w) for w in self.b_bytes], np.int64)
        self.n_b = len(texts)

    def _joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.b_bytes.__getitem__, ids))

    def _whole_b(self, text: str) -> np.ndarray:
        ids = self.b.encode(text)
        return np.array(ids if text and self._joined(ids) == b" " + text.encode() else [], np.uint32)

    def _words_b(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        lines = joined(words.distinct, LINE)
        flat = np.fromiter(chain.from_iterable(self.b.encode(lines, num_threads=1)), np.uint32)
        if self._joined(flat.tolist()) == b"".join(b" " + line.encode() for line in lines):
            return flat, counted(self.b_lengths[flat], words.sizes)
        each = [self._whole_b(w) for w in words.distinct.to_pylist()]  # a word that loses bytes has no ids, which no other word has
        return np.concatenate(each), np.array([len(x) for x in each])

    def batch(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A and by B; none at all for an empty text or one whose tokens do not give its bytes again."""
        words, nothing = Words(texts), np.zeros(0, np.uint32)
        a, b = [nothing] * len(texts), [nothing] * len(texts)
        for i in words.whole:
            if text := texts[i].as_py():
                a[i], b[i] = self.a.plain(" " + text), self._whole_b(text)
        words.ids(a, *self.a.words(words))
        words.ids(b, *self._words_b(words))
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64) + 1
        for i, size in enumerate(sizes.tolist()):
            if not (self.b_lengths[b[i]].sum() == self.a.lengths[a[i]].sum() == size):
                a[i] = b[i] = nothing
        return a, b


_loaded: dict[tuple, object] = {}


def loaded(kind: type, *paths: str | None):
    """A worker's own tokenizer, read once."""
    if (kind, paths) not in _loaded:
        _loaded[kind, paths] = kind(*paths)
    return _loaded[kind, paths]
