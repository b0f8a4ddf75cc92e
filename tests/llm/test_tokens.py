"""Sources' terms, packing and alignment against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trackframe.llm import alignment, divergence, packing, tokens

DOCS = "doc_id long, text string, lang string, source string"
BITS = ["a", "B", "é", "日本", "▁", "the", "tion", "'s", ".", ",", "1", "23", "🙂", "<|endoftext|>", "<s>", "<0x41>", "\x00", "\x1c", "\n", "\t", "  ", "　", " ", " ", " ", " "]


def corpus(seed=5, n=90):
    """Words of three languages and seven sources, odd characters, copies, nulls, empty and long texts."""
    draw = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "éta", "x1y", "o'clock", "日本", "zeta", "ETA", "iota"]
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(words) for _ in range(draw.choice([2, 9, 40]))) if i % 3 else "".join(draw.choice(BITS) for _ in range(30))
        rows.append([i, text, ["en", "de", None][i % 3 if i % 11 else 0], f"s{i * i % 7}" if i % 13 else None])
    for i in (7, 8, 9, 10):
        rows[i][1] = rows[6][1]
    rows[20][1], rows[21][1], rows[22][1] = None, "", " \n "
    rows[23][1] = "word " * 3000 + "end"
    rows[24][2], rows[24][3], rows[24][1] = "xx", "lonely", "4711"
    rows += [list(rows[30]), [None, "alpha Beta", "en", "s1"]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def odd(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(1).alias(n) for n in ("digest", "row", "task", "place", "rank", "pairs", "length", "number")))


def plain_divergence(rows, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(low))
        df[lang].update(set(found))
        n[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= least]
        v, share = len(kept), {}
        whole = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})
        total = sum(whole.values())
        q = {t: 1 + 10**9 * (whole[t] + 5) // (total + 5 * v) for t in kept}
        for s in sources:
            size = sum(n[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10**9 * (n[lang, s][t] + 5) // (size + 5 * v) for t in kept}
        for s in sources:
            pair = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-(share[s][t] - q[t]), t.encode()) for t in kept if n[lang, s][t] and share[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -f, k + 1) for k, (f, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("bits, least, top", [(64, 3, 50), (3, 3, 2), (2, 2, 50), (64, 1000, 50)])
def test_divergence_matches_plain_loops(docs, bits, least, top):
    """Also where nearly all terms share a digest, over several blocks of sources and chunks of terms, and without kept terms."""
    got = divergence.divergence(odd(docs), least=least, top=top, bits=bits, block=3, chunk=4)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    want = plain_divergence(corpus(), least, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_divergence_joins_groups_that_are_not_few(docs):
    want = plain_divergence(corpus(), 3, 50)
    assert sorted(map(tuple, divergence.divergence(docs, least=3, broadcast=0).collect())) == want


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.place("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(tokens.place("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    return own, plain, tokens.Pair()


def test_ids_are_the_tokenizers_own(encoders):
    own, plain, pair = encoders
    draw = random.Random(2)
    texts = ["".join(draw.choice(BITS) for _ in range(draw.randrange(14))) for _ in range(4000)] + ["", " ", "a b", " a", "a  b", "a\n b"]
    a = pair.a.batch(pa.array(texts))
    assert [x.tolist() for x in a] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    both = pair.batch(pa.array(texts))
    for text, x, y in zip(texts, *both):
        ids = pair.b.encode(text)
        if text and b"".join(pair.b_bytes[i] for i in ids) == b" " + text.encode():
            assert x.tolist() == plain.encode(" " + text, add_special_tokens=False).ids and y.tolist() == ids
        else:
            assert not len(x) and not len(y)


def pieces_of(ids, capacity):
    bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
    return [(p, lo, hi - lo, ids[lo:hi]) for p, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]


@pytest.mark.parametrize("capacity, broadcast", [(1024, packing.BROADCAST), (16, 0)])
def test_packing_places_every_piece_once(docs, encoders, capacity, broadcast):
    own = encoders[0]
    packed = packing.pack(odd(docs), capacity=capacity, ids=True, broadcast=broadcast)
    rows = packed.collect()
    want = Counter()
    for key, text, *_ in corpus():
        for piece, start, length, ids in pieces_of([*own.encode(text or "", add_special_tokens=False).ids, 2], capacity):
            want[key, piece, start, length, zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    left = np.bincount([r.length for r in rows], minlength=capacity + 1)
    assert len(by_sequence) <= 1.1 * sum(n for _, n in packing.best_fit(left, capacity)) + 1
    joined = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in rows:
        assert joined[r.sequence_id].ids[r.offset : r.offset + r.length] == list(r.ids)


def test_best_fit_by_histogram_is_best_fit_by_piece():
    draw = random.Random(4)
    for capacity in (10, 37, 64):
        for _ in range(40):
            lengths = sorted((draw.randint(1, capacity) for _ in range(draw.randrange(1, 120))), reverse=True)
            room = []
            for x in lengths:
                fit = [k for k in range(len(room)) if room[k] >= x]
                if fit:
                    room[min(fit, key=lambda k: room[k])] -= x
                else:
                    room.append(capacity - x)
            found = packing.best_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
            assert sum(n for _, n in found) == len(room)
            used = Counter()
            for parts, n in found:
                assert sum(a * b for a, b in parts) <= capacity
                for a, b in parts:
                    used[a] += b * n
            assert used == Counter(lengths)


def test_fit_meets_the_conditions_of_an_optimum():
    """At the end no gradient is large and active ones vanish; a histogram made of patterns is fitted exactly."""
    rng = np.random.default_rng(7)
    capacity = 24
    choices = packing.patterns(np.arange(1, capacity), capacity)
    assert all(c.sum() == capacity and c[0] >= c[1] >= c[2] for c in choices)
    assert len({tuple(c) for c in choices}) == len(choices) == sum(1 for a in range(capacity) for b in range(a + 1) for c in range(b + 1) if a + b + c == capacity)
    weight = (np.arange(capacity + 1) / capacity) ** 2
    for _ in range(10):
        b = rng.integers(0, 10_000, capacity + 1)
        b[0] = b[capacity] = 0
        x = packing.nnls(choices, b)
        table = np.zeros((capacity + 1, len(choices)))
        for j, c in enumerate(choices):
            np.add.at(table[:, j], c[c > 0], 1)
        gradient = table.T @ (weight * (b - table @ x))
        scale = (table.T @ (weight * b)).max()
        assert (x >= 0).all() and gradient.max() <= max(0.5, packing.GAIN * scale) + 1e-6
        assert np.abs(gradient[x > 0]).max(initial=0) < 1e-6 * scale
    made = table @ np.eye(len(choices))[3] * 500
    assert sum(n for _, n in packing.plan({k: int(v) for k, v in enumerate(made) if v}, capacity)) == 500


def plain_alignment(rows, encoders):
    _, plain, pair = encoders
    a_bytes = {i: w for w, i in pair.a.encoding._mergeable_ranks.items()}
    each = []
    for key, text, *_ in rows:
        a, b = plain.encode(" " + (text or ""), add_special_tokens=False).ids, pair.b.encode(text or "")
        said = b" " + (text or "").encode()
        if not text or b"".join(pair.b_bytes[i] for i in b) != said:
            a, b = [], []
        ends_a, ends_b = np.cumsum([0, *(len(a_bytes[i]) for i in a)]).tolist(), np.cumsum([0, *(len(pair.b_bytes[i]) for i in b)]).tolist()
        links, j = [], 0
        for i in range(len(a)):
            j = max(j - 1, 0)
            while j < len(b) and ends_b[j] < ends_a[i + 1]:
                if ends_b[j + 1] > ends_a[i]:
                    links.append((a[i], b[j]))
                j += 1
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [(a[ends_a.index(x) : ends_a.index(y)], b[ends_b.index(x) : ends_b.index(y)]) for x, y in zip(cuts, cuts[1:])]
        each.append((key, a, b, links, groups))
    n = Counter(link for e in each for link in e[3])
    best = defaultdict(int)
    for (_, b), k in n.items():
        best[b] = max(best[b], k)
    out = []
    for key, a, b, links, groups in each:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(n[x] == best[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else "", said))
    return sorted(out, key=repr)


@pytest.mark.parametrize("known", [0, 12, alignment.KNOWN])
def test_alignment_matches_plain_loops(docs, encoders, known):
    """Also where only some pairs, or none, are known to all tasks and the rest is joined."""
    rows = [r if r[0] != 23 else (23, "word " * 300 + "end", *r[2:]) for r in corpus()]
    frame = docs.sparkSession.createDataFrame(rows, DOCS).repartition(3)
    got = alignment.align(odd(frame), groups=True, known=known)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(rows, encoders)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert divergence.divergence(none).count() == packing.pack(none).count() == alignment.align(none).count() == 0
