"""Jaccard join, substring dedup, line dedup, decontamination: against plain versions."""

import random

import brute
import numpy as np
import pytest

from sparkclean.llm import decontaminate, jaccard, lines, substrings
from sparkclean.llm.common import gram_hashes


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_gram_hashes_are_hashes_of_windows():
    h = np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64)
    for n in (1, 2, 3, 5, 7, 50):
        got = gram_hashes(np.r_[h, h], n)
        assert len(got) == 121 - n and (got[: 61 - n] == got[60:]).all() and len(set(got.tolist())) == 60
    assert len(gram_hashes(h, 61)) == 0


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_classes(docs, corpus, n, percent):
    got = rows_of(jaccard.classes(docs, n, percent), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.classes(corpus, n, percent), key=repr)


def test_jaccard_chain_and_group(spark):
    """A chain of links that needs both steps, and a group of near copies of one text."""
    base = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join([f"v{j}" for j in range(3 * k)] + base[3 * k :])) for k in range(12)]
    r = random.Random(2)
    for d in range(200, 240):
        own = [f"g{i}" for i in range(60)]
        own[r.randrange(60)] = f"e{d}"
        rows.append((d, " ".join(own)))
    got = rows_of(jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.classes(rows, 3, 90), key=repr)


def test_jaccard_empty(no_docs):
    assert jaccard.classes(no_docs, 3, 90).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (60, 61)] + [(100, k) for k in range(101, 140)]
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    want = {i: 0 for i in range(31)} | {40: 40, 41: 40, 50: 40, 60: 60, 61: 60} | {k: 100 for k in range(100, 140)}
    assert got == want


@pytest.mark.parametrize("size", [50, 5])
def test_substrings(docs, corpus, size):
    found = substrings.deduplicated(docs, size).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found), key=repr)
    assert got == sorted(brute.without_repeats(corpus, size), key=repr)
    for r in found:
        ends = [x for p in r["removed"] for x in (p["from"], p["to"])]
        assert ends == sorted(set(ends)) and sum(p["to"] - p["from"] for p in r["removed"]) == r["n_removed"]


def test_substrings_empty(no_docs):
    assert substrings.deduplicated(no_docs).collect() == []


def test_lines(spark):
    r = random.Random(9)
    own = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(20)) for _ in range(104)]
    rows = []
    for d in range(12):
        rows.append((d, "\n".join([*own[4 * d : 4 * d + 4], f"Page {d} of 99 printed on host h{d}", "", "Follow us on the net today"])))
    copy = "\n".join(own[80:84])
    rows += [(20 + d, copy) for d in range(8)]  # copies keep their lines
    rows += [(30, None), (31, ""), (32, "Follow us on the net today"), (None, "Follow us on the net today"), rows[0]]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, line int, dropped string")
    got = {}
    for r in lines.deduplicated(df).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["dropped_lines"]))
        assert r["line"] == 1 and r["dropped"] == "x"
    for d in range(12):
        assert all(x == ("\n".join([*own[4 * d : 4 * d + 4], ""]), [4, 6]) for x in got[d])
    assert len(got[0]) == 2
    assert all(got[20 + d] == [(copy, [])] for d in range(8))
    assert got[30] == [(None, [])] and got[31] == [("", [])] and got[32] == [("", [0])]
    assert got[None] == [("Follow us on the net today", [])]


def _prose(seed, n):
    r = random.Random(seed)
    return [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(n)]


def test_lines_of_copied_and_short_documents(spark):
    """A footer of documents with one copy each, and one that is most of its documents; near copies keep their lines."""
    own, small, base = _prose(1, 24), _prose(2, 6), _prose(3, 10)
    foot, notice = "Sent from the reading room of the town", "This long notice of the house goes under every page that it prints for its readers and for all others"
    rows = [(2 * d + c, "\n".join([*own[3 * d : 3 * d + 3], foot])) for d in range(8) for c in range(2)]
    rows += [(100 + d, small[d][:20] + "\n" + notice) for d in range(6)]
    near = []
    for d in range(9):
        edited = [x.split(" ") for x in base]
        edited[d][5] = f"edit{'abcdefghi'[d]}"
        near.append((200 + d, "\n".join(map(" ".join, edited))))
    got = {r["doc_id"]: r["dropped_lines"] for r in lines.deduplicated(spark.createDataFrame(rows + near, "doc_id bigint, text string")).collect()}
    assert all(got[d] == [3] for d in range(16))
    assert all(got[100 + d] == [1] for d in range(6))
    assert all(got[200 + d] == [] for d in range(9))


def test_lines_of_many_templates_in_one_leaf(spark, monkeypatch):
    """Templates of the same leading words and length, each with a field of words that never recur."""
    monkeypatch.setattr(lines, "AT_ONCE", 3)  # several passes
    own, tails, names = _prose(4, 60), _prose(5, 7), [w for x in _prose(6, 10) for w in x.split(" ")]
    rows = []
    for d in range(60):
        tail = tails[d % 7].split(" ")
        rows.append((d, own[d] + "\n" + " ".join(["Brought to you", *tail[:3], names[d], *tail[3:]])))
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["dropped_lines"] == [1] for r in got) and len(got) == 60


def test_lines_plan_is_native(docs):
    plan = lines.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_empty_and_untouched(no_docs, docs, corpus):
    assert lines.deduplicated(no_docs).collect() == []
    assert lines.deduplicated(docs).count() == len(corpus)


def test_tiles_against_plain_version():
    r = random.Random(4)
    for _ in range(150):
        # tokens are hashes: large numbers, of which few are alike here
        item = [r.randint(1, 6) << 55 for _ in range(r.randint(1, 14))]
        doc = [r.randint(1, 6) << 55 for _ in range(r.randint(1, 30))]
        got = decontaminate.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        marked, tiles = brute.tiling(doc, item, 3)
        assert [t[2] for t in got][:1] == tiles[:1]
        used_doc, used_item = [p for i, _, n in got for p in range(i, i + n)], [p for _, j, n in got for p in range(j, j + n)]
        assert len(set(used_doc)) == len(used_doc) and len(set(used_item)) == len(used_item)
        assert all(doc[i + k] == item[j + k] for i, j, n in got for k in range(n)) and all(t[2] >= 3 for t in got)


ITEMS = [
    (1, "Which of the seven bridges, built by the old guild, did the river carry away in the flood of that long winter?"),
    (2, "short one"),
    (3, None),
    (4, ""),
    (None, "an item without any id that nothing can match at all"),
]


def test_decontamination(spark):
    item = ITEMS[0][1]
    halves = item.split(" ")
    docs = [
        (10, "Before. " + item.upper() + " After."),
        (11, " ".join(halves[11:]) + " and so on and on " + " ".join(halves[:11])),  # reordered
        (12, " ".join(halves[:9])),  # less than the share
        (13, "of the and by the old"),
        (14, "this is a short one indeed"),
        (15, None), (16, ""), (None, item), (10, "Before. " + item.upper() + " After."), (17, "word " * 5000 + item),
    ]
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id bigint, text string, coverage int")
    bench = spark.createDataFrame([(*i, "x") for i in [*ITEMS, ITEMS[0]]], "item_id bigint, text string, matches string")
    for block in (2_000_000, 5):
        got = rows_of(decontaminate.contaminated(df, bench, block_tokens=block), "doc_id", "item_id")
        assert got == sorted([(10, 1), (10, 1), (11, 1), (14, 2), (17, 1), (None, 1)], key=repr)
    row = decontaminate.contaminated(df, bench).filter("doc_id = 17").first()
    assert row["spans"] == [[5000, 22]] and row["coverage"] == 1.0 and row["matched"] == row["item_tokens"] == 22
    kept = decontaminate.clean_documents(df, bench)
    assert kept.columns == df.columns and rows_of(kept, "doc_id") == [(12,), (13,), (15,), (16,)]


def test_decontamination_of_repetitive_items(spark):
    """A seed that recurs in an item marks its tokens at every place."""
    refrain, table = " ".join(["row the boat"] * 8), " ".join(["0 1 1 0"] * 20) + " end"
    bench = spark.createDataFrame([(1, refrain), (2, table)], "item_id bigint, text string")
    docs = [(1, "so they sang " + refrain + " until dawn"), (2, table), (3, "row the boat and row the boat"), (4, "0 1 1 0 0 1"), (5, " ".join(["row the boat"] * 5))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = rows_of(decontaminate.contaminated(df, bench), "doc_id", "item_id", "matched", "item_tokens")
    assert got == [(1, 1, 24, 24), (2, 2, 81, 81), (5, 1, 15, 24)]
    assert rows_of(decontaminate.clean_documents(df, bench), "doc_id") == [(3,), (4,)]


def test_candidates_lose_no_tiling():
    """Whatever tiling marks to the share is a candidate, also with few kinds of tokens."""
    r = random.Random(12)
    hits = 0
    for _ in range(300):
        item = [r.randint(1, 3) for _ in range(r.randint(1, 40))] if r.random() < 0.5 else [1, 2, 3][: r.randint(1, 3)] * r.randint(1, 12)
        doc = item[r.randrange(len(item)) :] + [r.randint(1, 3) for _ in range(r.randint(0, 20))]
        items = decontaminate.Items(["x"], [np.array(item, np.uint64)], 4, 0.6)
        marked = brute.tiling(doc, item, min(4, len(item)))[0]
        found = list(items.candidates(np.array(doc, np.uint64), np.array([0, len(doc)])))
        assert found or marked < 0.6 * len(item), (doc, item)
        hits += marked >= 0.6 * len(item)
    assert hits > 50


def test_decontamination_empty(docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.contaminated(no_docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect() == []
    assert decontaminate.clean_documents(docs, none).count() == docs.count()
