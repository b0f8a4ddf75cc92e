import functools
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.llm import common, decontaminate, jaccard, katz, langid, linededup, mixing, pii, queries, repeats, telephony, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1):
    """Small texts with copies, near copies, a shared passage, nulls, empty and long texts, repeated rows."""
    draw = random.Random(seed)
    words = {"en": "the of and thing ation ether house".split(), "de": "der und schön über Straße nicht".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = " ".join(draw.choice(words[lang]) + draw.choice(["", "s", "er", str(draw.randrange(40))]) for _ in range(draw.choice([3, 30, 120])))
        rows.append([i, text, lang, f"s{i % 4}", len(text)])
    passage = " ".join(f"p{k}" for k in range(70))
    for i in (5, 17, 31):
        rows[i][1] = f"{rows[i][1]} {passage} {rows[i][1]}"
    for i in (20, 21, 22):
        rows[i][1] = rows[19][1] = " ".join(f"c{k}" for k in range(100))
    rows[22][1] = rows[22][1].replace("c50", "Z")
    rows[23][1] = rows[22][1].replace("c90", "Y")
    rows[40][1], rows[41][1], rows[42][1] = None, "", " \n\t "
    rows[43][1] = "x y " * 6000
    rows[44][3] = None
    rows.append(list(rows[50]))
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def odd(docs):
    """With extra columns whose names clash with those used inside."""
    names = ["n_words", "h", "pos", "class", "size", "score", "lang_pred", "digest", "shard", "anchor", "__other"]
    return docs.select("*", *(F.lit(1).alias(n) for n in names))


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_rolling_tells_windows_apart():
    h = common.hash_words([str(i % 7).encode() for i in range(200)])
    for width in (1, 2, 5, 8, 50):
        r = common.rolling(h, width)
        assert len(r) == 201 - width
        assert len(set(r.tolist())) == len({tuple(h[i : i + width].tolist()) for i in range(len(r))})
    assert len(common.rolling(h[:3], 5)) == 0


def test_near_duplicates_match_brute_force(spark, docs):
    rows = corpus()
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd(docs)).collect())
    assert got == sorted((i, len(s), top(i)) for i, s in sets)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {top(i) for i, _ in sets}


def test_long_lists_lose_no_link(spark):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(draw.randrange(6)):
            w[draw.randrange(60)] = f"x{draw.randrange(30)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(12):
        for i in sets:
            for j in sets:
                if label[j] < label[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label


def test_blocks_of_long_lists_hold_every_pair_of_different_components(spark):
    draw = random.Random(8)
    lists = [(t, 1000 * t + i, 9, i, g) for t, n in ((1, 90), (2, 30), (3, 12)) for i in range(n) for g in [draw.choice([7, 7, 7, 7, 20 + i % 9, 500 + i]) if t < 3 else 7]]
    table = spark.createDataFrame([x[:4] for x in lists], "token long, class long, size int, pos int")
    so_far = spark.createDataFrame([(x[1], x[4]) for x in lists], "node long, component long")
    pairs, sizes = set(), {}
    for r in jaccard.block_members(table, so_far, 8).collect():
        sizes.setdefault((r.token, r.one, r.two), []).append((r["class"], r.group, r.side))
    for (token, _, _), members in sizes.items():
        assert len(members) <= 40
        pairs |= {(token, *sorted((a[0], b[0]))) for a in members for b in members if a[0] != b[0] and a[1] != b[1] and (a[2] == 0 or a[2] != b[2])}
    want = {(a[0], *sorted((a[1], b[1]))) for a in lists for b in lists if a[0] == b[0] and a[4] != b[4]}
    assert pairs == want and not any(t == 3 for t, _, _ in sizes)


def test_dealt_lists_lose_no_link(spark, monkeypatch):
    """Lists that the sketch tells to be long are dealt to several groups."""
    monkeypatch.setattr(jaccard, "LIST", 10)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choice([w, w, w, w, w, w, w, w, w, w, w, w, f"x{draw.randrange(30)}"]) for w in base)) for i in range(120)]
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(12):
        for i in sets:
            for j in sets:
                if label[j] < label[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label


@pytest.mark.parametrize("listed", [50_000, 10])
def test_every_link_is_listed_and_counted(spark, monkeypatch, listed):
    monkeypatch.setattr(jaccard, "LIST", listed)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    draw = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choice([w] * 60 + [f"x{draw.randrange(30)}"]) for w in base)) for i in range(100)]
    rows += [(200 + i, t) for i, t in rows[:20]] + [(300 + i, " ".join(base)) for i in range(30)] + [(400, None), (401, ""), (402, "a b"), (403, "A b"), (None, rows[0][1]), (5, " ".join(base))]
    sets = [shingle_set(t) for _, t in rows]
    like = [[100 * len(a & b) >= 80 * len(a | b) for b in sets if a and b] if a else [] for a in sets]
    members, links = jaccard.near_links(odd(spark.createDataFrame(rows, "doc_id long, text string")))
    got = members.collect()
    order = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=order) == sorted(((k, len(s), max(sum(n) - 1, 0)) for (k, _), s, n in zip(rows, sets, like)), key=order)
    of = {(r.doc_id, r.n_shingles): r["class"] for r in got if r.doc_id not in (None, 5)}
    name = {frozenset(s): of[k, len(s)] for (k, _), s in zip(rows, sets) if k not in (None, 5)}
    kinds = [s for s in {frozenset(s) for s in sets} if s and s in name]
    want = {tuple(sorted((name[a], name[b]))) for a in kinds for b in kinds if a != b and 100 * len(a & b) >= 80 * len(a | b)}
    pairs = [(r.a, r.b) for r in links.collect()]
    assert len(pairs) == len(set(pairs)) and {p for p in pairs if set(p) <= set(name.values())} == want and len(want) > 100


def test_rows_that_share_a_key_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(4, a), (5, a), (5, b), (6, b), (7, "c d e f g h"), (8, None), (8, "")]
    got = [(r.doc_id, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(4, 4), (5, 4), (5, 4), (6, 4), (7, 7), (8, 8), (8, 8)]
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_block_pairs_skip_nothing_needed():
    draw = np.random.default_rng(5)
    pos, size = np.sort(draw.integers(0, 30, 700)), draw.integers(20, 60, 700)
    found = {tuple(sorted(x)) for i, j in jaccard.block_pairs(pos, size, None, 80, 64) for x in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if min(size[i] - pos[i], size[j] - pos[j]) >= -(-(size[i] + size[j]) * 80 // 180) - 1}
    assert found == want


def test_repeats_match_brute_force(spark, docs):
    rows = corpus()
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    first = {}
    for k, w in sorted(words, key=lambda x: x[0]):
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), k)
    want = []
    for k, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < k:
                gone[p : p + 50] = [True] * 50
        want.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.find_repeats(odd(docs)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[2] for r in want) > 200


def test_katz_sums_to_one_and_beats_the_base(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    out = katz.score(odd(docs), held).collect()
    assert len(out) == docs.count()
    training = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    counts = {}
    for r in training:
        for w in [*(r[1] or "").encode().lower().split(), b"\n"]:
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    texts = {r[0]: r[1] for r in corpus()}
    for r in out:
        w = [*(texts[r.doc_id] or "").encode().lower().split(), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), total)
        assert r.base_score == pytest.approx(math.fsum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), abs=1e-9, rel=1e-12)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    model, _ = katz.count_words(docs.where(~held))
    pairs, table = katz.count_pairs(docs.where(~held), model, 8)
    classes = np.append(np.arange(len(model.hashes)), [katz.END, katz.OTHER])
    seen = {}
    for row in table.collect():
        seen |= dict(zip(np.frombuffer(row.keys, np.uint32).tolist(), np.frombuffer(row.counts, np.int64).tolist()))
    assert model.p[classes].sum() == pytest.approx(1)
    for h in classes:
        c = np.array([seen.get(int(h) * katz.CLASSES + int(x), 0) for x in classes])
        assert (10 ** pairs.log10(model, np.full(len(classes), h), classes, c)).sum() == pytest.approx(1)


@pytest.mark.parametrize("vocabulary", [0, 12, 50_000])
def test_katz_counts_every_pair_at_any_vocabulary(spark, docs, vocabulary):
    rows = [[*(r[1] or "").encode().lower().split(), b"\n"] for r in corpus()]
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in corpus()]
    unigrams, bigrams, follow = {}, {}, {}
    for ws in (w for w, h in zip(rows, held) if not h):
        for a, b in zip([b"\n", *ws], ws):
            unigrams[b] = unigrams.get(b, 0) + 1
            bigrams[a, b] = bigrams.get((a, b), 0) + 1
    for (a, b), c in bigrams.items():
        follow.setdefault(a, {})[b] = c
    d = katz.discounts([0, *(sum(c == r for c in bigrams.values()) for r in range(1, katz.K + 2))])
    model, _ = katz.count_words(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 1), vocabulary=vocabulary)
    own = lambda w: float(model.own(np.array(unigrams.get(w, 0))))
    weight = {}
    for a, next_words in follow.items():
        total = sum(next_words.values())
        seen, rest = sum(d[min(c, katz.K + 1)] * c for c in next_words.values()) / total, 1 - sum(map(own, next_words))
        free = max(1 - seen, 0.5 / (total + 1)) if rest > 1e-9 else 0
        weight[a] = (free / max(rest, 1e-9), (1 - free) / seen / total)
    want = []
    for r, ws in zip(corpus(), rows):
        score = pairs = 0
        for a, b in zip([b"\n", *ws], ws):
            c = bigrams.get((a, b), 0)
            back, scale = weight.get(a, (1.0, 0.0))
            score, pairs = score + math.log10(scale * d[min(c, katz.K + 1)] * c if c else back * own(b)), pairs + (c > 0)
        want.append((r[0], pairs, pytest.approx(score)))
    out = katz.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, vocabulary=vocabulary).collect()
    assert sorted((r.doc_id, r.n_pairs_seen, r.score) for r in out) == sorted(want, key=lambda x: x[0])


def test_discounts():
    d = katz.discounts([0, 1000, 400, 200, 120, 80, 55])
    assert all(0 < x < 1 for x in d[1:6]) and d[6] == 1
    assert all(0 < x < 1 for x in katz.discounts([0, 3, 0, 0, 0, 0, 0])[1:6])


def test_katz_without_training(spark):
    out = katz.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (out.n_tokens, out.n_known, out.train_tokens) == (3, 0, 0) and out.held_out


def test_line_dedup_against_sql(spark, tmp_path):
    draw = random.Random(2)
    line = lambda: draw.choice("abcdefg")
    rows = [(i, None if i == 7 else "\n".join(line() for _ in range(draw.randrange(12)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.SQL["op3_line_dedup"]).fetchall()
    got = [tuple(r) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got)


def test_line_dedup_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc\nd", 5), (2, "x\na\nb\nc", 6), (None, "a\nb\nc", 7), (4, None, 8)], "doc_id long, text string, pos int")
    out = {r.doc_id: (r.text, r.pos, r.n_removed) for r in linededup.drop_repeated_lines(rows).collect()}
    assert out == {None: ("a\nb\nc", 7, 0), 1: ("d", 5, 3), 2: ("x", 6, 3), 4: (None, 8, 0)}


def test_line_dedup_with_clashing_names_long_texts_and_repeated_rows(spark):
    long = "\n".join(f"l{i}" for i in range(20_000))
    rows = [(1, long, 1, 2, 3, 4), (2, f"x\n{long}", 1, 2, 3, 4), (2, f"x\n{long}", 1, 2, 3, 4), (3, "", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__dedup_key` int, key int, covered int, lines int")
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_removed, r["key"]) for r in out.collect()) == [(1, long, 0, 2), (2, "x", 20_000, 2), (2, "x", 20_000, 2), (3, "", 0, 2)]
    assert linededup.drop_repeated_lines(docs.limit(0)).count() == 0


PII = "Mail a.b@c-d.org, x@y or @z.com; 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5.6.7.8; 4111 1111 1111 1111 or 4111111111111112; +1 (068) 555-2748, +12. " 'token = "9dd3c80004c73dc9e548fee51b23b527780d4f20"'


def test_pii_patterns():
    got = {(k, PII[s:e]) for k, s, e in pii.base_spans(PII)}
    assert got == {("email", "a.b@c-d.org"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (068) 555-2748")}


def test_pii_model_adds_spans(spark):
    rows = [(i, f"word here token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and 4111 1111 1111 1111 or mail n{i}@ex.com so") for i in range(30)]
    rows += [(100, None), (101, ""), (102, PII)]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100].spans == "" and out[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "secret:" in out[3].spans and out[3].n_card == 1 and out[3].n_email == 1
    assert (out[102].n_email, out[102].n_ip, out[102].n_card, out[102].n_phone) == (1, 3, 1, 1)


def test_pii_model_sees_texts_without_digits_and_long_spans(spark):
    draw = random.Random(6)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    model = pii.teach([f'some text password = "{word(20)}" and more' for _ in range(60)])
    text = f'some text password = "{word(20)}" and more'
    out = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame([(1, text), (2, text + " 7")], "doc_id long, text string"), model).collect()}
    assert out[1] == out[2] and "secret:" in out[1]
    long = f'token="{word(600)}1"'
    assert any(b - a > 600 for words in pii.islands(long) for row in pii.lattice(long, words) for _, a, b, _ in row)


def test_pii_islands_close_with_a_word_and_know_no_characters():
    text = "aa bb 11 " + "x" * 200 + " " + "y" * 90 + ' 22 cc dd ee ff gg hh token="short" end'
    words = [[text[a:b] for a, b, _ in w] for w in pii.islands(text)]
    assert words == [["bb", "11", "x" * 200, "y" * 90, "22", "cc"], ["hh", 'token="short"', "end"]]
    assert [len(w) for w in pii.islands("1")] == [1] and list(pii.islands("")) == [] and list(pii.islands("a b")) == []
    assert any(text[a:b] == "short" for w in pii.islands(text) for row in pii.lattice(text, w) for _, a, b, _ in row)
    long = "7 " + "w " * 100_000 + "8 " + "v" * 1_000_000 + " 9"
    assert [len(w) for w in pii.islands(long)] == [2, 4]


def test_pii_repeated_rows_and_clashing_names(spark):
    rows = [(1, PII), (1, PII), (2, None), (3, "")]
    docs = odd(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({"spans": F.lit(1), "n_email": F.lit(1), "n_spans": F.lit(1)})
    out = sorted((r.doc_id, r.n_email, r.spans, r.n_spans) for r in pii.find_personal_data(docs).collect())
    assert len(out) == 4 and out[0] == out[1] and out[0][1] == 1 and out[0][3] == len(out[0][2].split(",")) and out[2:] == [(2, 0, "", 0), (3, 0, "", 0)]


def test_pii_finds_secrets_that_its_patterns_do_not_match():
    draw = random.Random(9)
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    hexed, mixed = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    filler = lambda n: " ".join(f"w{draw.randrange(50)}" if draw.random() < 0.1 else draw.choice(["the", "of", "state-of-the-art-2020", "in", "1999", "a-4"]) for _ in range(n))
    model = pii.teach([f"{filler(20)} {draw.choice(['token', 'key', 'password'])} = {some(hexed, 32)} {filler(20)}" for _ in range(80)])
    cases, found, wrong = 0, 0, 0
    for cue in ("Authorization: Bearer {}", "my login is {} please", "passphrase {} was sent"):
        for secret in (some(hexed, 40), some(mixed, 28) + "7", "sk-" + some(mixed, 32) + "7"):
            for _ in range(20):
                text = f"{filler(15)} {cue.format(secret)} {filler(15)}"
                assert not pii.ASSIGNED.search(text)
                at = text.index(secret)
                spans = pii.added_spans(model, text, pii.base_spans(text))
                cases, found, wrong = cases + 1, found + (("secret", at, at + len(secret)) in spans), wrong + sum(s[1:] != (at, at + len(secret)) for s in spans)
    assert found >= 0.7 * cases and wrong <= 0.05 * cases, (found, wrong, cases)


def test_pii_segmentation_is_the_best_of_all():
    """The dynamic program against every segmentation of a short island."""
    model = pii.teach([f"call +1 (068) 555-27{i:02d} or token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\"" for i in range(20)])
    text = "so 11 22 at 33@x 44 55 and"
    for words in pii.islands(text):
        segments = pii.lattice(text, words)

        @functools.cache
        def best(j, y):
            if j == 0:
                return 0.0 if y == 0 else -np.inf
            top = -np.inf
            for k in range(len(pii.TYPES)):
                if y == 0:
                    top = max(top, best(j - 1, k) + model.moves[k, 0])
                else:
                    for i, _, _, f in segments[j - 1]:
                        top = max(top, best(i, k) + model.moves[k, y] + model.score(f)[y])
            return top

        found, at, last, total = pii.best(model, segments), 0, 0, 0.0
        by_end = {(a, b): (i, j, f) for j, row in enumerate(segments) for i, a, b, f in row}
        for y, a, b in found:
            i, j, f = by_end[a, b]
            for _ in range(i - at):
                total, last = total + model.moves[last, 0], 0
            total, last, at = total + model.moves[last, y] + model.score(f)[y], y, j + 1
        for _ in range(len(words) - at):
            total, last = total + model.moves[last, 0], 0
        assert total == pytest.approx(max(best(len(words), y) for y in range(len(pii.TYPES))))


def test_telephony_round_trip(spark, docs):
    assert (int(telephony.MU[0]), int(telephony.MU[255]), int(telephony.A[0x55 ^ 0x80])) == (-32124, 0, 8)
    out = telephony.load(telephony.store(odd(docs))).collect()
    texts = {r[0]: (r[1] or "").encode() for r in corpus()}
    for r in out:
        payload = telephony.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert len(r.pcm16k) == 4 * len(payload) and r.media_bytes == len(telephony.to_wav(payload)) and r.media_sha256 == hashlib.sha256(telephony.to_wav(payload)).hexdigest()
        assert np.array_equal(np.frombuffer(r.pcm16k, np.int16)[::2], telephony.MU[np.frombuffer(payload, np.uint8)])


def test_adpcm_matches_a_scalar_decoder():
    blocks = np.random.default_rng(1).integers(0, 256, (5, 64), dtype=np.uint8)
    for block, got in zip(blocks, telephony.decode_adpcm(blocks)):
        sample, index, out = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), min(int(block[2]), 88), []
        out.append(sample)
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
                index = max(0, min(88, index + int(telephony.CHANGES[code])))
                out.append(sample)
        assert got.tolist() == out


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague(seed):
    draw = random.Random(seed)
    votes, seats = [draw.choice([0, 1, 5, 5, 100, 999]) for _ in range(draw.randrange(1, 9))], draw.randrange(60)
    won = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    assert mixing.sainte_lague(np.array(votes), seats).tolist() == won


def test_mixing(spark, docs):
    out = mixing.mix_sources(odd(docs), block=8).collect()
    again = mixing.mix_sources(docs.repartition(7), block=8).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert set(by) == {"s0", "s1", "s2", "s3", None}
    assert sum(v[0] for v in by.values()) == pytest.approx(sum(v[2] for v in by.values()))
    assert all(abs(taken - target) <= 24 + 0.02 * target and target <= 3 * size + 1e-9 for target, taken, size in by.values())
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_deals_rows_without_a_key(spark):
    """Null keys are dealt to shards by their text, and the quota is kept."""
    rows = [(None, " ".join(f"w{i}" for _ in range(1 + i % 9)), "a" if i % 2 else None) for i in range(400)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8, shard_docs=20).collect()
    assert len(out) == 400 and all(0 <= r.taken <= 3 * r.size for r in out)
    for source in ("a", None):
        some = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in some) - some[0].target) <= 0.1 * some[0].target


def test_language_id(spark, docs):
    rows = [r for r in corpus() if r[1] and len(r[1]) > 20]
    model = langid.fit(docs)
    out = {r.doc_id: r for r in langid.predict(odd(docs), model).collect()}
    assert sum(out[r[0]].lang_pred == r[2] for r in rows if r[0] not in (19, 20, 21, 22, 23, 43)) >= 0.9 * (len(rows) - 6)
    assert out[40].lang_pred == out[41].lang_pred == "und" and out[40].score == 0
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = langid.kept(odd(docs), model, 0.0)
    assert kept.columns == odd(docs).columns and 40 not in {r.doc_id for r in kept.collect()}
    assert langid.predict(docs, langid.Model([])).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_id_reads_runs_without_spaces_whole(spark):
    draw = random.Random(4)
    head = "".join(chr(0x4E00 + i) for i in range(45))
    kinds = {"aa": range(0x5000, 0x5030), "bb": range(0x6000, 0x6030)}
    rows = [(i, head + "".join(chr(draw.choice(kinds["aa" if i % 2 else "bb"])) for _ in range(draw.choice([200, 9_000]))), "aa" if i % 2 else "bb") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.predict(docs, langid.fit(docs)).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in out)
    assert "".join(langid.pieces(rows[0][1])) == rows[0][1]


def test_language_id_learns_rare_languages_and_long_texts(spark):
    rows = [(100 * y + i, " ".join(f"{chr(97 + y % 26)}{chr(97 + y // 26)}{chr(97 + k % 26)}{'xy'[k % 2]}" for k in range(3_000 if y == 67 else 30)), f"l{y:02d}") for y in range(68) for i in range(1 if y >= 66 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 68 and min(len(r[1]) for r in rows if r[2] == "l67") > 8_000
    out = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert sum(out[r[0]] == r[2] for r in rows) >= 0.9 * len(rows) and (out[6600], out[6700]) == ("l66", "l67")


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_forward_backward_matches_enumeration(block):
    import itertools

    draw = np.random.default_rng(4)
    moves, lengths = draw.normal(size=(2, 2)), np.array([3, 0, 1, 5, 4])
    scores = draw.normal(size=(13, 2))
    got = langid.forward_backward(langid.likelihoods(scores), lengths, moves, block)
    at = 0
    for n in lengths:
        p = np.zeros((n, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            w = np.exp(sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                p[i, y] += w
        assert n == 0 or np.allclose(got[at : at + n], p / p.sum(1, keepdims=True))
        at += n


def test_forward_backward_over_a_long_text():
    draw = np.random.default_rng(6)
    moves, emit = draw.normal(size=(4, 4)), np.exp(draw.normal(size=(20_000, 4)) * 3)
    go, fore, aft = np.exp(moves), np.empty_like(emit), np.ones_like(emit)
    fore[0] = emit[0] / emit[0].sum()
    for t in range(1, len(emit)):
        x = (fore[t - 1] @ go) * emit[t]
        fore[t] = x / x.sum()
    for t in range(len(emit) - 2, -1, -1):
        x = go @ (aft[t + 1] * emit[t + 1])
        aft[t] = x / x.sum()
    want = fore * aft
    got = langid.forward_backward(emit, np.array([20_000]), moves)
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_word_features_do_not_depend_on_neighbours():
    words = ["a", "The", "Straße", "x²", "½", "12", "über", "abcdefgh", "中文"]
    weights = np.random.default_rng(2).normal(size=(1 << langid.BITS, 3)).astype(np.float32)
    together = langid.Features(words)
    assert together.letter.tolist() == [True, True, True, True, False, False, True, True, True]
    for i, w in enumerate(words):
        assert np.allclose(langid.Features([w]).scores(weights)[0], together.scores(weights)[i], atol=1e-4)
    feat, own = together.listed()
    sums = np.zeros((len(words), 3))
    np.add.at(sums, own, weights[feat])
    assert np.allclose(sums, together.scores(weights), atol=1e-4)
    assert len(langid.Features([]).scores(weights)) == 0


def test_decontamination(spark):
    draw = random.Random(9)
    item = [f"q{draw.randrange(500)}" for _ in range(30)]
    noisy = list(item)
    for i in (4, 13, 22):
        noisy[i] = "changed"
    fill = " ".join(f"z{k}" for k in range(40))
    rows = [(1, f"{fill} {' '.join(item)} {fill}"), (2, f"{fill} {' '.join(noisy)} end"), (3, fill), (4, None), (5, ""), (6, " ".join(item[:14])), (7, " ".join(item[:10])), (8, "Short, one here!")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "short one HERE"), (5, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_agree for r in decontaminate.contaminated(odd(docs), bench).collect()}
    assert got == {(1, 1): 30, (2, 1): 27, (6, 1): 14, (8, 4): 3}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, 4, 5, 7}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(1, 21))
def test_seeds_hit_every_pattern_of_substitutions(n):
    """Every placing of the allowed substitutions has the least number of hits on its diagonal, whether the item is as long or longer."""
    import itertools

    item = common.hash_words([f"q{i}".encode() for i in range(n)])
    seeds, places = decontaminate.seeds_of(item)
    least = max((h for m, h in decontaminate.LEAST_HITS.items() if m == min(n, 13)), default=1)
    for c in (c for m in range(n // 5 + 1) for c in itertools.combinations(range(n), m)):
        changed = np.where(np.isin(np.arange(n), c), item ^ np.uint64(1), item)
        doc = np.concatenate([item[:1] ^ np.uint64(5), changed])
        hits = sum(int(((x := decontaminate.masked(doc, m))[p + 1 : p + 2] == s).any()) for m in decontaminate.masks_of(n) for s, p in zip(seeds.tolist(), places.tolist()) if len(doc) >= len(m))
        assert hits >= least, c
        assert decontaminate.overlap(doc, item, 1, 13, 0.8)


def test_decontamination_matches_brute_force(spark):
    """Against every diagonal of every pair, over texts with random substitutions, repeated and null rows."""
    draw = random.Random(21)
    word = lambda: f"w{draw.randrange(60)}"
    items = [[word() for _ in range(draw.choice([1, 2, 3, 4, 5, 6, 8, 10, 12, 13, 15, 20, 40]))] for _ in range(25)]
    rows = []
    for i in range(150):
        text = [f"z{draw.randrange(999)}" for _ in range(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            part = list(draw.choice(items))
            lo = draw.randrange(max(1, len(part) - 12))
            part = [draw.choice([w, w, w, w, w, w, "X"]) for w in part[lo:]]
            at = draw.randrange(len(text) + 1)
            text[at:at] = part
        rows.append((i, " ".join(text)))
    rows += [rows[3], rows[3], (200, None), (201, ""), (202, "y " * 20_000 + " ".join(items[-1]))]
    want = []
    for i, t in rows:
        h = decontaminate.word_hashes((t or "").encode())
        for k, words in enumerate(items):
            o = decontaminate.word_hashes(" ".join(words).encode())
            best = max((decontaminate.overlap(h, o, d, 13, 0.8) for d in range(-len(o), len(h))), default=0)
            want += [(i, k, best)] if best and words not in items[:k] else []
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    table = odd(spark.createDataFrame(rows, "doc_id long, text string"))
    for known in (0, decontaminate.KNOWN):
        got = [(r.doc_id, r.item_id, r.n_agree) for r in decontaminate.contaminated(table, bench, known=known).collect()]
        assert sorted(got) == sorted(want) and len(want) > 60


PAGE = '<html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p>one <b>two</b><br>three<p>four</p><div class="comments"><p>me</p></div></article><footer>f</footer></body></html>'


def test_wrappers(spark):
    other = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    rows = [(1, "http://a.com/1", PAGE), (2, "http://a.com/2", PAGE.replace("<p>four</p>", "<p>x</p>" * 40)), (3, "http://b.org/1", other), (4, None, None), (5, "odd", ""), (6, "http://a.com/1", PAGE)]
    out = {r.page_id: r.text for r in wrappers.extract(odd(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert out[1] == out[6] == "A & B\none two three\nfour"
    assert out[2] == "A & B\none two three\n" + "\n".join(["x"] * 40)
    assert out[3] == out[1] and out[4] == out[5] == ""


def prose(draw, n):
    return " ".join(f"{draw.choice('bcdfgklmnprst')}{draw.choice('aeiou')}{draw.choice('bcdfgklmnprst')}{draw.randrange(99)}" for _ in range(n))


def labelled(seed, hosts=12, pages=9):
    """(page_id, url, html, main text): hosts with layouts of neutral class names, some with misleading ones."""
    draw, out = random.Random(seed), []
    for h in range(hosts):
        wrap = draw.choice(["section", "div", "main", "article"])
        body, head, foot, side = (f"{x}{draw.choice('abcdefghij')}" for x in ("k", "m", "r", "v"))
        body = draw.choice([body, "related-work", "post"])
        same, notice, title_in = prose(draw, 6), prose(draw, 12), draw.random() < 0.5
        for i in range(pages):
            title, paragraphs = prose(draw, 5), [prose(draw, draw.randrange(8, 60)) for _ in range(draw.randrange(2, 9))]
            menu = "".join(f"<li><a href=/{k}>{prose(draw, 1)}</a></li>" for k in range(draw.randrange(3, 8)))
            extra = f"<div class='{side}'><p>{notice}</p></div>" if draw.random() < 0.7 else ""
            comments = "<div class=comments>" + "".join(f"<p>{prose(draw, 9)}</p>" for _ in range(draw.randrange(4))) + "</div>"
            inner = "".join(f"<p>{p}</p>" for p in paragraphs)
            block = f"<{wrap} class='{body}'><h1>{title}</h1>{inner}{comments}</{wrap}>" if title_in else f"<h1>{title}</h1><{wrap} class='{body}'>{inner}{comments}</{wrap}>"
            html = f"<html><head><title>{title}</title></head><body><div class='{head}'><b>{same}</b></div><ul class='nav'>{menu}</ul>{extra}<article class=teaser><p>{prose(draw, 4)}</p></article>{block}<div class='{foot}'>{same} {notice}</div></body></html>"
            out.append((100 * h + i, f"http://h{h}.org/{i}", html, [title, *paragraphs]))
    return out


def test_main_text_of_labelled_pages(spark):
    cases = [(10_000 * s + k, url.replace('//', f'//s{s}'), html, want) for s in (3, 4, 5) for k, url, html, want in labelled(s)]
    got = {r.page_id: r.text.split("\n") for r in wrappers.extract(spark.createDataFrame([c[:3] for c in cases], "page_id long, url string, html string").repartition(5)).collect()}
    words = lambda blocks: sum(len(x.split()) for x in blocks)
    hit = sum(words([x for x in got[k] if x in want]) for k, _, _, want in cases)
    recall, precision = hit / sum(words(c[3]) for c in cases), hit / sum(map(words, got.values()))
    assert recall >= 0.98 and precision >= 0.95, (recall, precision)


def host_text(pages):
    wrapper = None
    for html in pages:
        own = wrappers.as_wrapper(wrappers.parse(html)[0])
        wrapper = own if wrapper is None else wrappers.align(wrapper, own)
    wrappers.content(wrapper)
    return [wrappers.main_text(html, wrapper) for html in pages]


def test_constant_slots_are_template():
    draw = random.Random(1)
    body = [[prose(draw, 30) for _ in range(3)] for _ in range(8)]
    pages = ["<div class=c7>Sign in / All rights kept</div><div class=x>" + "".join(f"<p>{p}</p>" for p in ps) + "</div><div class=c8>Same foot</div>" for ps in body]
    assert host_text(pages) == ["\n".join(ps) for ps in body]


def test_names_do_not_hide_the_body():
    draw = random.Random(2)
    for name in ("related-work", "has-sidebar", "no-header"):
        body = [[prose(draw, 30) for _ in range(3)] for _ in range(3)]
        assert host_text([f"<nav><a href=x>menu</a></nav><div class={name}>" + "".join(f"<p>{p}</p>" for p in ps) + "</div><footer>f</footer>" for ps in body]) == ["\n".join(ps) for ps in body]


def test_a_teaser_does_not_win_over_the_body():
    draw = random.Random(3)
    body = [[prose(draw, 30) for _ in range(6)] for _ in range(3)]
    assert host_text([f"<article class=teaser><p>{prose(draw, 5)}</p></article><div class=m>" + "".join(f"<p>{p}</p>" for p in ps) + "</div>" for ps in body]) == ["\n".join(ps) for ps in body]


def test_most_siblings_are_matched_at_every_size():
    def most(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[j]))
            row = new
        return row[-1]

    draw = random.Random(5)
    for size in [8] * 500 + [60] * 20 + [400] * 2:
        a, b = ([draw.choice("abcdefghij"[: draw.randint(1, 10)]) for _ in range(draw.randint(0, size))] for _ in range(2))
        pairs = list(wrappers.matched(a, b))
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in both) and len(both) == most(a, b)
    a, b = ([str(draw.randrange(40)) for _ in range(n)] for n in (2_300, 2_500))
    few = lambda n: sum(i is not None and j is not None for i, j in wrappers.matched(a[:n], b[:n]))
    assert few(2_500) == most(a, b)


def test_compounds_of_function_names_are_told_by_their_slots():
    said = lambda i, k: " ".join(f"w{i}x{k}y{j}" for j in range(20))
    page = lambda i, inside: f"<body><article><h1>t{i}</h1><p>{said(i, 1)}</p>{inside}<p>{said(i, 2)}</p></article></body>"
    for name in ("menu-ideas", "widget-review", "share-story"):
        pages = [page(i, f"<div class='{name}'><p>{said(i, 3)}</p></div>") for i in range(6)]
        assert host_text(pages) == [f"t{i}\n{said(i, 1)}\n{said(i, 3)}\n{said(i, 2)}" for i in range(6)]
    for name, inside in (("menu-ideas", "<a>{}</a>"), ("menu-ideas", "same on every page"), ("share-story", "short {i}"), ("comment-list", "{}"), ("sidebar-widget", "{}"), ("menu", "{}"), ("share-form", "{}")):
        pages = [page(i, f"<div class='{name}'>{inside.format(said(i, 3), i=i)}</div>") for i in range(6)]
        assert host_text(pages) == [f"t{i}\n{said(i, 1)}\n{said(i, 2)}" for i in range(6)], name


@pytest.mark.parametrize("html", ["<a " * 30_000, '<a "' * 30_000, "<div>" * 30_000 + "x", "<x><li>" * 10_000, "</q>" * 30_000, "<!--" * 30_000, "".join(f"<div class={'ab'[i * 7919 % 101 % 2]}>t{i}</div>" for i in range(5_000))])
def test_odd_pages_take_no_long_time(html):
    import time

    began = time.time()
    wrappers.main_text(html, None)
    assert time.time() - began < 8


def test_wrapper_alignment():
    a, b = (wrappers.as_wrapper(wrappers.parse(x)[0]) for x in ("<div><h1>t</h1><p>a</p><p>b</p></div>", "<div><p>a</p><ul><li>x</li></ul></div>"))
    assert wrappers.printed(wrappers.align(a, b)) == "<div>(<h1>#</h1>)?(<p>#</p>)+(<ul><li>#</li></ul>)?</div>"
    long = wrappers.as_wrapper(wrappers.parse("".join(f"<h{k}>{i}</h{k}>" for i in range(3) for k in range(1, 7)) + "<p>x</p>")[0])
    assert wrappers.printed(long) == "(" + "".join(f"<h{k}>#</h{k}>" for k in range(1, 7)) + ")+<p>#</p>"
    for x, y in (("abcde", "axcze"), ("", "ab"), ("abab", "baba")):
        for limit in (0, 10**9):
            pairs = list(wrappers.matched(list(x), list(y)))
            assert [i for i, _ in pairs if i is not None] == list(range(len(x))) and [j for _, j in pairs if j is not None] == list(range(len(y))), limit


def test_hosts_are_joined_in_levels(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 2)
    cases = [(k, "http://one.org/", html, want) for k, _, html, want in labelled(5, 1, 9)]
    table = spark.createDataFrame([c[:3] for c in cases], "page_id long, url string, html string").repartition(9)
    assert {r.page_id: r.text.split("\n") for r in wrappers.extract(table).collect()} == {k: want for k, _, _, want in cases}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard.near_duplicates(none).count() == 0
    assert repeats.find_repeats(none).count() == 0
    assert linededup.drop_repeated_lines(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert telephony.load(telephony.store(none)).count() == 0
    assert katz.score(none, F.lit(False)).count() == 0
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_rows_without_a_key_go_to_no_shard(spark):
    """A third of all rows without a key, copies of each other and of rows with one: they stay whole, and only the others are compared."""
    text = " ".join(f"k{i}" for i in range(80))
    rows = [(None, text)] * 200 + [(None, None), (3, text), (5, text + " end"), (7, "short")]
    out = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.n_words, r.n_removed) for r in out if r.doc_id is None) == [(0, 0)] + [(80, 0)] * 200
    assert {r.doc_id: (r.n_words, r.n_removed) for r in out if r.doc_id is not None} == {3: (80, 0), 5: (81, 80), 7: (1, 0)}


def without_repeated_lines(rows):
    """(key, text) rows without lines of three-line windows that stand earlier, by key and position."""
    first, out = {}, []
    lines = sorted((k, (t or "").split("\n")) for k, t in rows)
    for k, ls in lines:
        for p in range(len(ls) - 2):
            first.setdefault(tuple(ls[p : p + 3]), (k, p))
    for k, ls in lines:
        gone = {q for p in range(len(ls) - 2) if first[tuple(ls[p : p + 3])] != (k, p) for q in (p, p + 1, p + 2)}
        out.append((k, "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    return out


def smallest_of_groups(rows):
    """Keys that are the smallest of what links reach."""
    sets, label = {k: shingle_set(t) for k, t in rows}, {k: k for k, _ in rows}
    moved = True
    while moved:
        moved = False
        for i, a in sets.items():
            for j, b in sets.items():
                if label[j] < label[i] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i], moved = label[j], True
    return {k for k, top in label.items() if k == top}


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Every stage on what the one before has left, against loops over all rows."""
    import corpus_pipeline

    draw = random.Random(4)
    line = lambda: " ".join(f"w{draw.randrange(300)}" for _ in range(7))
    shared = [line() for _ in range(6)]
    rows = []
    for i in range(80):
        ls = [line() for _ in range(draw.randrange(2, 9))]
        if i % 7 == 0:
            ls[1:1] = shared[: draw.choice([2, 3, 5])]
        if i % 5 == 1:
            ls = rows[draw.randrange(len(rows))][1].split("\n")
            ls[0] = " ".join(draw.choice([w] * 20 + ["x"]) for w in ls[0].split(" "))
        rows.append((i, "\n".join(ls), "en", f"s{i % 3}", 1))
    items = [(1, rows[8][1].split("\n")[0] + " " + rows[8][1].split("\n")[1]), (2, "k l m n o p q r s t u v w x y")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        seen[name] = before, sorted(docs.collect(), key=lambda r: r.doc_id)
    texts = {name: [(r.doc_id, r.text) for r in after] for name, (_, after) in seen.items() if name != "source_mixing"}
    assert texts["language_id"] == seen["language_id"][0]  # one language, nothing to reject
    assert texts["line_dedup"] == without_repeated_lines(seen["line_dedup"][0]) != seen["line_dedup"][0]
    kept = smallest_of_groups(seen["near_duplicates"][0])
    assert texts["near_duplicates"] == [x for x in seen["near_duplicates"][0] if x[0] in kept] and len(kept) < 80
    hashed = [decontaminate.word_hashes(t.encode()) for _, t in items]
    hit = {k for k, t in seen["benchmark_decontamination"][0] for o in hashed for d in range(-len(o), len(t.split())) if decontaminate.overlap(decontaminate.word_hashes(t.encode()), o, d, 13, 0.8)}
    assert texts["benchmark_decontamination"] == [x for x in seen["benchmark_decontamination"][0] if x[0] not in hit] and hit
    mixed = seen["source_mixing"][1]
    assert [(r.doc_id, r.size) for r in mixed] == [(k, len(t.split())) for k, t in seen["source_mixing"][0]]
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [(r.doc_id, r.taken) for r in mixed]


def test_pipeline_stages_take_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "q w e r t y u i o p a s d f"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(None, "der und schön über Straße", None, None, None), (1, None, "de", "s", 3), (2, "", "de", None, 0), (3, long, "de", "s", 5), (3, long, "de", "s", 5), (4, long, None, "t", 5), (5, "1 2 3", "de", "s", 5)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(1) for n in ("gone", "covered", "lines", "key", "size", "class", "shard", "doc", "lang_pred", "score")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name == "language_id":
            assert {r.doc_id for r in out} <= {None, 3, 4}
        elif name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in out) == ["1", "2", "3", "3", "5", "None"]
        else:
            assert len(out) == len(rows), name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(corpus(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"p{k}" for k in range(70)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not out & {40, 41, 42, 20, 5}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
