"""Operators that judge each document by itself, packing and nearest neighbours."""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkclean.llm import ann, lattice, licenses, packing, prefix_tokens, quality

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
# text fragments that are hard for the splitting rules of tokenizers
HARD = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "!", "?!", "1", "23", "\u00e9", "e\u0301", "\u0301", "\u00df", "\u4e2d", "\U0001f642",
        "<|endoftext|>", "<|endo", "<|startoftext|>", "\u2003", "ing", "\u0130", "\u03a3", "\x1c", "ll", "S", "\u212b", "...", "\xa0", "\x85", "\n\n"]


def hard_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(HARD, k=r.randint(0, 12))) for _ in range(n)]


# ---------------------------------------------------------------- tokens


def test_every_prefix_count():
    library, counter = Tokenizer.from_file(BYTES), prefix_tokens.PrefixCounter(BYTES)
    for t in hard_texts(600):
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        steps = counter.steps(t)
        assert prefix_tokens.prefix_counts(steps).tolist() == want, t
        for budget in (0, 1, 3):
            assert prefix_tokens.longest_prefix(steps, budget) == max(i for i, c in enumerate(want) if c <= budget)


def test_token_counts(docs, corpus, no_docs):
    library = Tokenizer.from_file(BYTES)
    got = sorted((tuple(r)[:4] for r in prefix_tokens.token_counts(docs, BYTES).collect()), key=repr)
    size = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in corpus]
    assert got == sorted(((*x, x[2] > 1024) for x in size), key=repr)
    assert prefix_tokens.token_counts(no_docs, BYTES).collect() == []


def test_prefix_table_answers_budgets(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "")], "doc_id bigint, text string")
    table = prefix_tokens.prefix_table(df, BYTES)
    assert sorted(map(tuple, table.select("doc_id", "n_bytes", "n_tokens").collect())) == [(1, 18, 4), (2, 0, 0), (3, 0, 0)]
    got = dict(map(tuple, prefix_tokens.budget_prefixes(table, 2).collect()))
    assert got[1] == len("one two ") - 1 or got[1] == len("one two") and got[2] == got[3] == 0


# ---------------------------------------------------------------- packing


def test_word_encoder_equals_library():
    library, encoder = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    texts = hard_texts(1500) + ["Word, word. WORD! stra\u00dfe. \u0130. x" * 3]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_complements_fill_exactly():
    assert packing.plan({60: 1, 40: 1}, 100).sequences == 1
    assert packing.plan({50: 1, 30: 1, 20: 1}, 100).sequences == 1
    assert packing.plan({40: 3, 30: 3, 20: 3, 10: 3}, 100).sequences == 3
    assert packing.plan({}, 100).sequences == 0 and packing.plan({100: 7}, 100).sequences == 7


def test_plans_are_sound():
    r = random.Random(1)
    for _ in range(150):
        capacity = r.choice([10, 50, 4096])
        counts = Counter(r.choice([r.randint(1, capacity), r.randint(1, max(1, capacity // 8)), capacity]) for _ in range(r.randint(0, 300)))
        made = packing.plan(dict(counts), capacity)
        ranks, content = defaultdict(list), defaultdict(list)
        for length, rank, n, sequence, offset in made.places:
            ranks[length].append((rank, n))
            for k in range(n):
                content[sequence + k].append((offset, length))
        for length, n in counts.items():
            end = 0
            for rank, many in sorted(ranks[length]):
                assert rank == end
                end += many
            assert end == n
        for parts in content.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(content) == made.sequences
        least = -(-sum(k * n for k, n in counts.items()) // capacity)
        assert made.sequences <= max(least, sum(n for k, n in counts.items() if 2 * k > capacity)) * 1.25 + 2


def test_packing(docs, corpus, no_docs):
    library = Tokenizer.from_file(WORDS)
    got = packing.pack(packing.pieces(docs, WORDS)).collect()
    parts = []
    for d, t in corpus:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            own = ids[s : s + 4096]
            parts.append((d, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(parts, key=repr)
    content = defaultdict(list)
    for r in got:
        content[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in content.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(content) <= -(-sum(p[3] for p in parts) // 4096) + 1
    assert packing.pack(packing.pieces(no_docs, WORDS)).collect() == []


# ---------------------------------------------------------------- quality


def test_quality(spark, docs, corpus, no_docs):
    r = random.Random(6)
    vocabulary = ["".join(r.choices("aeinorst", k=r.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for d in range(400):
        own = r.choices(vocabulary, k=r.randint(20, 80))
        bad = d % 4 == 0
        rows.append((d, "!! ".join(w.upper() for w in own) if bad else " ".join(own) + "."))
        labels.append((d, 0 if bad else 1))
    labels += [(1000, 1), (None, 0), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int"), max_rows=100)
    held = [x["predicted"] == (x["doc_id"] % 4 != 0) for x in quality.score(df, model).collect() if zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(held) / len(held) > 0.95
    found = quality.score(docs, model, keep=["doc_id", "size"]).collect()
    assert len(found) == len(corpus) and all(0 <= x["score"] <= 1 for x in found)
    assert all(x["predicted"] == (x["score"] >= 0.7) for x in found)
    assert quality.score(no_docs, model).collect() == []


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none), keep=["doc_id"]).collect()} == {0.5}
    ones = spark.createDataFrame([(0, 1), (1, 1), (3, 1), (4, 1)], "doc_id bigint, quality int")
    assert all(r["predicted"] == 1 for r in quality.score(docs, quality.fit(docs, ones), keep=["doc_id"]).collect())


# ---------------------------------------------------------------- licences


def test_licenses(spark, no_docs):
    rows = [
        (1, "Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "Released under the MIT License."),
        (3, "You need a licence to fish here, and the work of the public is free."), (4, None), (5, ""), (6, " \n\n"),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"),
        (8, "x" * 50_000 + "\nAll rights reserved."), (None, "All rights reserved."), (2, "Released under the MIT License."),
        (9, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame([(d, t, None) for d, t in rows], "doc_id bigint, text string, family string")
    model = licenses.fit(df)
    found = licenses.scan(df, model)
    got = sorted(((r["doc_id"], r["paragraph"], r["family"]) for r in found.collect()), key=repr)
    want = [(1, 1, "Apache-2.0"), (2, 0, "MIT"), (2, 0, "MIT"), (7, 0, "MIT"), (8, 1, "proprietary"), (None, 0, "proprietary"), (9, 0, "GPL"), (9, 1, "CC-BY-NC")]
    assert got == sorted(want, key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan.replace("ExistingRDD[doc_id", "")
    assert licenses.scan(no_docs, licenses.fit(no_docs)).collect() == []


def test_license_scores_against_plain_version(spark):
    r = random.Random(8)
    pool = [w for ts in licenses.NOTICES.values() for t in ts for w in t.split()] + ["river", "stone"] * 20
    rows = [(d, " ".join(r.choices(pool, k=r.randint(1, 25)))) for d in range(150)]
    rows += [(200 + k, "so " + t) for k, t in enumerate(t for ts in licenses.NOTICES.values() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = licenses.fit(df)
    place = {g: i for i, g in enumerate(model.grams)}
    want = {}
    for d, t in rows:
        grams = licenses._grams_of(licenses._words_of(t))
        known = [place[g] for g in grams if g in place]
        if not known:
            continue
        z = (np.round(model.weights[known], 6).sum(0) + model.bias) / model.temperature
        k = int(z.argmax())
        p = 1 / np.exp(z - z.max()).sum()
        if k < len(model.families) - 1 and p >= 0.5:
            notices = [set(licenses._grams_of(licenses._words_of(x))) for x in licenses.NOTICES[model.families[k]]]
            if max(len(n.intersection(grams)) / len(n) for n in notices) >= 0.6:
                want[d] = (model.families[k], round(p, 6))
    got = {x["doc_id"]: (x["family"], round(x["probability"], 6)) for x in licenses.scan(df, model).collect()}
    assert got == want and len(want) > 20


# ---------------------------------------------------------------- language model


def test_lattice_sums_all_segmentations():
    pieces = [lattice.START, lattice.START + "a", "a", "b", "ab", "ba", "aba"]
    log_p = np.log(np.array([0.2, 0.1, 0.15, 0.1, 0.2, 0.1, 0.1] + [0.05 / 256] * 256))

    def total(text):
        ways = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in pieces:
                    ways[j] += ways[i] * math.exp(log_p[pieces.index(text[i:j])])
            ways[j] += ways[j - 1] * math.exp(sum(log_p[len(pieces) + b] for b in text[j - 1].encode()))
        return math.log10(ways[-1])

    texts = ["a", "ab", "abab", "c\u00e9a", "b" * 40, ""]
    got = lattice.Lattice(pieces).log10_marginal(texts, log_p)
    assert np.allclose(got, [total(lattice.START + t) for t in texts])
    one = lattice.Lattice(pieces).expected(["ab"], np.ones(1), log_p)
    assert math.isclose(one[0] + one[1] + sum(one[7 + b] for b in lattice.START.encode()[:1]), 1, rel_tol=1e-9)


def test_scores(docs, corpus, no_docs):
    for most in (200_000, 5):  # all words travel; nearly all are joined
        got = sorted((tuple(r) for r in lattice.score(docs, PIECES, broadcast_words=most).collect()), key=repr)
        held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
        lists = [(d, [w.translate(brute.LOWER) for w in brute.words(t)] + [None]) for d, t in corpus]
        counts = Counter(w for d, ws in lists if not held(d) for w in ws)
        n, v = sum(counts.values()), len(counts)
        want = []
        for d, ws in lists:
            base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            want.append((d, held(d), len(ws), sum(counts[w] > 0 for w in ws), n, base))
        want.sort(key=repr)
        assert [x[:5] for x in got] == [x[:5] for x in want]
        assert np.allclose([x[5] for x in got], [x[5] for x in want])
        assert all(x[6] < 0 and math.isfinite(x[6]) and math.isfinite(x[7]) for x in got)
    assert lattice.score(no_docs, PIECES).collect() == []


def test_scores_are_probabilities(spark):
    """Known words of the training part are likelier than others of their length, and repeats cost their words."""
    df = spark.createDataFrame([(d, "the sea and the land " * (1 + d % 3)) for d in range(40)] + [(100 + d, x) for d, x in enumerate(["the", "xqz", "the the"])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in lattice.score(df, PIECES).collect()}
    assert got[100] > got[101] and got[102] < got[100]


# ---------------------------------------------------------------- neighbours


def test_neighbours(spark):
    r = np.random.default_rng(2)
    centers = r.normal(size=(20, 16)) * 3
    x = (centers[r.integers(0, 20, 3000)] + r.normal(size=(3000, 16))).astype(np.float32)
    x[100:700] = x[100]  # one vector in a fifth of the rows
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5150, [None] + [1.0] * 15), (5200, [1.0, 2.0]), (5250, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    found = ann.nearest(df, reads=24).cache()
    got = defaultdict(list)
    for q in sorted(map(tuple, found.collect())):
        got[q[0]].append(q[1:])
    unit = x.astype(float)
    hit, norm = 0, np.linalg.norm(unit, axis=1)
    assert sorted(got) == list(range(0, 3000, 50))
    for q, own in got.items():
        s = (unit * unit[q]).sum(1) / (norm * norm[q])
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and all(v != q and abs(c - s[v]) < 1e-12 for _, v, c in own)
        assert own == sorted(own, key=lambda o: (-o[2], o[1]))
        s[q] = -9
        hit += len({int(i) for i in np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]} & {v for _, v, _ in own})
    assert hit / (5 * len(got)) >= 0.9
    assert ann.recall(df, found, queries=40) >= 0.9


def test_neighbours_read_as_many_lists_as_recall_needs(spark):
    """Vectors without clusters, in far more lists than a query reads at first."""
    x = np.random.default_rng(4).normal(size=(3000, 24))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = ann.nearest(df, list_size=20, reads=2).cache()
    assert found.count() == 300 and ann.recall(df, found, queries=60) >= 0.9


def test_many_lists_are_read_without_copies_for_each(spark, monkeypatch):
    """Queries and rows meet by list or in blocks of queries, with the same result; a query of many lists is not copied."""
    r = np.random.default_rng(6)
    x = r.normal(size=(2000, 16))
    x[1500:] = x[:500] + r.normal(size=(500, 16)) * 0.01
    rows = [(i % 1900, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    monkeypatch.setattr(ann, "SHUFFLED", 0)
    by_list = sorted(map(tuple, ann.nearest(df, list_size=20, reads=8).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(ann, "_by_list", None)
    assert sorted(map(tuple, ann.nearest(df, list_size=20, reads=8).collect())) == by_list and len(by_list) >= 190
    monkeypatch.setattr(ann, "QUERY_BYTES", 3000)
    assert sorted(map(tuple, ann.nearest(df, list_size=20, reads=8).collect())) == by_list
    assert sorted(map(tuple, ann.nearest(df.filter("vec_id % 50 > 0"), list_size=20).collect())) == []


@pytest.mark.parametrize("rows,want", [([], []), ([(0, [1.0, 0.0])], []), ([(0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [4.0, 0.0]), (50, [0.0, 1.0])], [
    (0, 1, 3, 1.0), (0, 2, 7, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 3, 0.0), (50, 3, 7, 0.0),
])])
def test_few_neighbours(spark, rows, want):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, ann.nearest(df).collect())) == want


def test_nearest_of_repeated_rows(spark):
    """Rows that occur again change nothing, be they queries, answers or more than all that count."""
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows[7] = (7, rows[3][1])
    schema = "vec_id bigint, embedding array<double>"
    want = sorted(map(tuple, ann.nearest(spark.createDataFrame(rows, schema)).collect()))
    again = rows + [rows[0]] * 9 + [rows[3]] * 9 + rows[50:]
    assert sorted(map(tuple, ann.nearest(spark.createDataFrame(again, schema)).collect())) == want and len(want) == 10
