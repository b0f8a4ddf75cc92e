"""Seeds of many items are joined in pairs, and nothing is lost by that."""

import itertools
import random

import pytest

from trackframe.llm import decontaminate


@pytest.mark.parametrize("n", [8, 9, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20])
def test_every_allowed_overlap_has_a_pair_of_hits(n):
    """All placings of the substitutions that are allowed over n words; longer overlaps start and end with a match."""
    low, high = decontaminate.WITHIN[min(n, 13)]
    for k in range(n // 5 + 1):
        for changed in itertools.combinations(range(n), k):
            same = [i not in changed for i in range(n)]
            if n >= 13 and not (same[0] and same[-1]):
                continue
            starts = [p for m in decontaminate.MASKS for p in range(n - len(m) + 1) if all(same[p + i] for i, c in enumerate(m) if c == "1")]
            assert any(low <= abs(a - b) <= high for a, b in itertools.combinations(starts, 2))


def phrased(seed, items=40, docs=60):
    """Items and documents over few phrases of 5 to 14 words that most of them share, with changed words."""
    draw = random.Random(seed)
    phrases = [[f"p{k}w{i}" for i in range(size)] for k, size in enumerate((5, 6, 9, 11, 12, 14))]
    own = lambda n: [f"x{draw.randrange(400)}" for _ in range(n)]

    def text(parts):
        words = []
        for _ in range(parts):
            words += own(draw.randrange(5)) + draw.choice(phrases) + own(draw.randrange(5))
        return [w if draw.random() > 0.06 else f"y{draw.randrange(99)}" for w in words]

    bench = [(f"i{k}", " ".join(text(draw.choice([1, 1, 2]))[: draw.choice([7, 8, 9, 10, 11, 12, 13, 40])])) for k in range(items)]
    return bench, [(k, " ".join(text(3)) if k % 4 else " ".join([*own(9), *draw.choice(bench)[1].split(), *own(9)])) for k in range(docs)]


@pytest.mark.parametrize("seed, common", [(1, 2), (2, 0), (3, 16), (4, 5)])
def test_common_seeds_lose_no_overlap(spark, seed, common):
    """Against every diagonal of every document and item."""
    bench, rows = phrased(seed)
    want = {}
    hashed = {}
    for k, t in bench:  # of equal items the smallest is told
        hashed.setdefault(t, k)
        hashed[t] = min(hashed[t], k)
    for doc, t in rows:
        h = decontaminate.word_hashes(t.encode())
        for words, k in hashed.items():
            o = decontaminate.word_hashes(words.encode())
            best = max(decontaminate.overlap(h, o, d, 13, 0.8) for d in range(-len(o), len(h)))
            if best:
                want[doc, k] = best
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id string, text string"), common=common)
    assert {(r.doc_id, r.item_id): r.n_agree for r in found.collect()} == want and len(want) > 40


def test_a_common_phrase_joins_nothing(spark, monkeypatch):
    """300 items and 400 documents share five words and nothing else: no pair of them is looked at."""
    draw = random.Random(9)
    own = lambda n: " ".join(f"{draw.randrange(10**9)}" for _ in range(n))
    bench = [(f"i{k}", f"what is the value of {own(12)}") for k in range(300)]
    rows = [(k, f"{own(30)} what is the value of {own(30)}") for k in range(400)]
    frames = []
    keep = type(spark.range(1)).unionByName

    def seen(self, other, *args, **kw):
        frames.append(keep(self, other, *args, **kw))
        return frames[-1]

    monkeypatch.setattr(type(spark.range(1)), "unionByName", seen)
    assert decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")).count() == 0
    assert frames and frames[-1].columns == ["row", "item", "diagonal"] and frames[-1].count() <= 400


def test_shares_that_masks_can_miss_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        decontaminate.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"), share=0.7)
