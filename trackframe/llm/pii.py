"""Personal data by patterns and by a semi-Markov conditional random field.

Patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers. The model adds spans that the
patterns leave out: credentials (``secret``) and long identifying numbers (``number``). It scores whole candidate spans
of at most ``MAX_WORDS`` words by features of the span, and a dynamic program over spans picks boundaries and types
together. Only words with a digit, an at sign, a quote or an equals sign can start or end a span; all others carry no type, so the
program falls apart into islands of words around such words. An island takes in the word before and the word after it, so that the
moves from and to untyped words count, and what lies between islands is the same in every segmentation. Pattern spans stay
as they are: model spans that touch one are dropped. Spans are bounded in words alone, whatever the characters in them.

The model learns from a bounded sample of documents (``sample`` rows by key hash, at most ``max_chars`` characters each, islands of at
most 60 words) whose spans come from patterns and from key = value assignments; prediction takes every text and island whole. Null and
empty texts have no spans; very long texts are searched whole. Positions are code points, ends exclusive. Repeated rows give
repeated results; an empty table gives an empty result; columns other than key and text are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import keyed

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "number")
MAX_WORDS = 6

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ASSIGNED = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)\s*[=:]\s*["']?([A-Za-z0-9+/_\-]{12,})["']?""")
EVIDENCE = re.compile(r"""[0-9@"'=]""")
REST = re.compile(r"[^ \t-\r]*")
WORDS = re.compile(r"[^ \t-\r]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each at sign: the run of allowed characters before it, from the last match's end on."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


TYPES = ("O", *KINDS, *ADDED)
LEFT, RIGHT = "\"'([{<#$%&*!|", "\"')]}>#$%&*!|.,;:?"


SPACE = frozenset(" \t\n\v\f\r")


def words_before(text: str, end: int, start: int, most: int) -> list[tuple[int, int, bool]]:
    """The last words, ``most`` at most, between two positions, without evidence and in order."""
    out: list[tuple[int, int, bool]] = []
    while len(out) < most:
        while end > start and text[end - 1] in SPACE:
            end -= 1
        if end <= start:
            break
        at = end
        while at > start and text[at - 1] not in SPACE:
            at -= 1
        out.append((at, end, False))
        end = at
    return out[::-1]


def islands(text: str) -> Iterator[list[tuple[int, int, bool]]]:
    """Runs of words (start, end, evidence): words with evidence at most ``MAX_WORDS`` - 1 words apart, one word before and one after."""
    words: list[tuple[int, int, bool]] = []
    last = 0
    while m := EVIDENCE.search(text, last):
        start, end = m.start(), REST.match(text, m.start()).end()
        while start > last and text[start - 1] not in SPACE:
            start -= 1
        between = words_before(text, start, last, MAX_WORDS)
        if words and len(between) < MAX_WORDS:
            words += between
        else:
            if words:
                yield closed(text, words)
            words = between[-1:]
        words.append((start, end, True))
        last = end
    if words:
        yield closed(text, words)


def closed(text: str, words: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    after = WORDS.search(text, words[-1][1])
    return words + [(*after.span(), False)] if after else words


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without punctuation around it; of an assignment, the value."""
    cut = text.rfind("=", start, end - 1)
    if cut >= 0:
        start = cut + 1
    while start < end and text[start] in LEFT and text[start] != "(":
        start += 1
    while start < end and text[end - 1] in RIGHT:
        end -= 1
    return start, end


def shape(s: str) -> str:
    out = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-zÀ-ɏ]+", "a", s))
    return out if len(out) <= 12 else f"{out[:8]}~{min(len(out) // 8, 9)}"


def span_features(text: str, start: int, end: int, words: int, before: str) -> list[str]:
    """Features of a whole span: its shape, its digits and their checks, its length, its cue."""
    s = text[start:end]
    d, letters = digits_of(s), sum(c.isalpha() for c in s)
    long_hex = len(s) >= 20 and words == 1 and d != "" and letters > 0 and all(c.isalnum() or c in "-_+/" for c in s)
    out = [f"shape={shape(s)}", f"digits={min(len(d), 20)}", f"words={words}", f"letters={min(letters, 3)}", f"cue={before[-10:].lower()}"]
    out += [f"at={'@' in s}", f"plus={s[:1] == '+'}", f"dots={min(s.count('.'), 4)}", f"long={long_hex}", f"card={16 <= len(d) <= 19 and not letters}/{luhn(d) if 16 <= len(d) <= 19 and not letters else '-'}"]
    return out


class Model:
    """Weights by (feature, type); transitions between types of neighbouring segments."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((len(TYPES), len(TYPES)))

    def score(self, features: list[str]) -> np.ndarray:
        total = np.zeros(len(TYPES))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total


def lattice(text: str, words: list[tuple[int, int, bool]]) -> list[list[tuple[int, int, int, list[str]]]]:
    """By last word: candidate segments (first word, start, end, features). Only words with evidence bound a span."""
    out: list[list[tuple[int, int, int, list[str]]]] = [[] for _ in words]
    for j, (_, end, evidence) in enumerate(words):
        if not evidence:
            continue
        for i in range(j, max(-1, j - MAX_WORDS), -1):
            if not words[i][2]:
                continue
            a, b = trimmed(text, words[i][0], end)
            if b <= a or a >= words[i][1]:
                continue
            before = text[words[i - 1][0] : words[i - 1][1]] if i else ""
            cue = text[max(0, a - 12) : a] if "=" in text[max(0, a - 4) : a] else before
            out[j].append((i, a, b, span_features(text, a, b, j - i + 1, cue)))
    return out


def best(model: Model, segments: list[list[tuple[int, int, int, list[str]]]]) -> list[tuple[int, int, int]]:
    """The highest-scoring segmentation by dynamic programming: (type, start, end) of its typed segments."""
    n, t = len(segments), len(TYPES)
    top = np.full((n + 1, t), -np.inf)
    top[0, 0] = 0
    back: dict[tuple[int, int], tuple[int, int, tuple[int, int] | None]] = {}
    for j in range(n):
        step = top[j] + model.moves[:, 0]
        k = int(step.argmax())
        top[j + 1, 0], back[j + 1, 0] = step[k], (j, k, None)
        for i, a, b, features in segments[j]:
            score = model.score(features)
            reach = top[i][:, None] + model.moves
            prev = reach.argmax(0)
            total = reach[prev, np.arange(t)] + score
            for y in range(1, t):
                if total[y] > top[j + 1, y]:
                    top[j + 1, y], back[j + 1, y] = total[y], (i, int(prev[y]), (a, b))
    out, at, y = [], n, int(top[n].argmax())
    while at > 0:
        i, k, span = back[at, y]
        if span:
            out.append((y, *span))
        at, y = i, k
    return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    m[np.isinf(m)] = 0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def expectations(model: Model, segments: list[list[tuple[int, int, int, list[str]]]]) -> tuple[list[tuple[list[str], np.ndarray]], np.ndarray]:
    """Forward-backward over segments: the probability of each typed candidate, and of each move."""
    n, t = len(segments), len(TYPES)
    fore, aft = np.full((n + 1, t), -np.inf), np.full((n + 1, t), -np.inf)
    fore[0, 0] = 0
    scored = [[(i, f, np.concatenate([[-np.inf], model.score(f)[1:]])) for i, _, _, f in row] for row in segments]
    plain = np.concatenate([[0.0], np.full(t - 1, -np.inf)])
    for j in range(n):
        ways = [fore[j + 1], _log_sum(fore[j][:, None] + model.moves, 0) + plain]
        ways += [_log_sum(fore[i][:, None] + model.moves, 0) + s for i, _, s in scored[j]]
        fore[j + 1] = _log_sum(np.array(ways), 0)
    total = _log_sum(fore[n], 0)
    aft[n] = 0
    probs, moved = [], np.zeros((t, t))
    for j in range(n - 1, -1, -1):
        for i, f, s in [(j, None, plain), *scored[j]]:
            gain = model.moves + (s + aft[j + 1])[None, :]
            aft[i] = np.logaddexp(aft[i], _log_sum(gain, 1))
    for j in range(n):
        for i, f, s in [(j, None, plain), *scored[j]]:
            p = np.exp(fore[i][:, None] + model.moves + (s + aft[j + 1])[None, :] - total)
            moved += p
            if f is not None:
                probs.append((f, p.sum(0)))
    return probs, moved


def teach(texts: list[str], rounds: int = 6, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Stochastic gradient (AdaGrad) on the likelihood of spans that patterns and assignments give."""
    model, cases = Model(), []
    for text in texts:
        known = {(s, e): k for k, s, e in base_spans(text)} | {m.span(1): "secret" for m in ASSIGNED.finditer(text)}
        for m in CARD.finditer(text):
            if 16 <= len(digits_of(m[0])) <= 19:
                known.setdefault(m.span(), "number")
        for words in islands(text):
            if len(words) > 60:
                continue  # a fit on a sample; prediction takes islands of any length
            segments = lattice(text, words)
            taken, at, truth = [(a, b, i, j, f) for j, row in enumerate(segments) for i, a, b, f in row if (a, b) in known], 0, []
            for a, b, i, j, f in sorted(taken, key=lambda x: (x[2], -x[3])):
                if i >= at:
                    truth += [(None, 0)] * (i - at) + [(f, TYPES.index(known[a, b]))]
                    at = j + 1
            cases.append((segments, truth + [(None, 0)] * (len(words) - at)))
    seen: dict[str, np.ndarray] = {}
    moves_seen = np.full_like(model.moves, 1e-6)
    for r in range(rounds):
        for segments, truth in cases:
            change: dict[str, np.ndarray] = {}
            probs, moved = expectations(model, segments)
            for f, p in probs:
                for name in f:
                    change.setdefault(name, np.zeros(len(TYPES)))[1:] -= p[1:]
            moves, last = -moved, 0
            for f, y in truth:
                moves[last, y] += 1
                last = y
                for name in f or ():
                    change.setdefault(name, np.zeros(len(TYPES)))[y] += 1
            for name, g in change.items():
                w = model.weights.setdefault(name, np.zeros(len(TYPES)))
                g -= decay * w
                s = seen.setdefault(name, np.full(len(TYPES), 1e-6))
                s += g * g
                w += rate * g / np.sqrt(s)
            moves_seen += moves * moves
            model.moves += rate * 0.2 * moves / np.sqrt(moves_seen)
    return model


def added_spans(model: Model, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    for words in islands(text):
        segments = lattice(text, words)
        if not any(segments):
            continue
        for y, a, b in best(model, segments):
            if TYPES[y] in ADDED and not any(a < e and s < b for _, s, e in base):
                out.append((TYPES[y], a, b))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (rank[x[0]], x[1], x[2])))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 400, max_chars: int = 20_000) -> Model:
    """Learn from at most ``sample`` documents of at most ``max_chars`` characters that have a digit, lowest key hash first."""
    some = keyed(docs, key, text).where((F.length(text) <= max_chars) & F.col(text).rlike("[0-9]"))
    # A hash bound first: what tasks send to the driver stays near the sample's size however many there are.
    place = F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(1_000_000))
    near = some.where(place * some.count() <= (2 * sample + 60) * 1_000_000)
    rows = near.orderBy(place, key, text).limit(sample).select(text).collect()
    return teach([r[0] for r in rows])


def find_personal_data(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans): the counts by kind are those of the patterns' spans, ``n_spans`` counts all."""
    model = model or fit(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                if not t or not re.search("[0-9@\"'=]", t):
                    rows.append((0, 0, 0, 0, EMPTY, "", 0, 0))
                    continue
                base = base_spans(t)
                more = added_spans(model, t, base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more), len(base) + len(more)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [()] * 8, kinds))], NAMES)

    EMPTY = hashlib.sha256(b"").hexdigest()
    NAMES = [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]
    kind = docs.schema[key].dataType.simpleString()
    return keyed(docs, key, text).mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
