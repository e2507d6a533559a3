"""Collocations, web archives and importance resampling against plain versions."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from sparkclean.llm import collocations, importance, warc

# ---------------------------------------------------------------- collocations


def plain_phrases(rows, least, percent, top, longest=4):
    """Everything by counting lists of words."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (x, q), b in f.items() if x == lang and b >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:c]], f[lang, p[c:]]))
    return sorted(
        (lang, rank, p.decode(), -a, x, y, total[lang], -s)
        for lang, found in out.items()
        for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)
    )


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (5, 7)])
def test_collocations(spark, least, top):
    r = random.Random(7)
    words = ["New", "york", "city", "hall", "É", "é", "a\x1cb", "to", "the\x00", "of", " ", "x"]
    rows = []
    for _ in range(150):
        w = [r.choice(words) for _ in range(r.randint(0, 25))]
        text = "".join(x + r.choice([" ", " ", " ", "\t", " \t ", ". ", "\n", ", ", "\r", "\x0b"]) for x in w)
        rows.append((r.choice(["en", "en", "en", "de", None, "und", ""]), text))
    rows += [("en", "New York City Hall")] * 9 + [("en", None), (None, None), ("fr", ""), ("en", "a " * 5000), ("en", " .. ,")]
    schema = "lang string, text string, phrase int, n int, rank string, k int, _salt int"
    df = spark.createDataFrame([(*x, *[None] * 5) for x in rows], schema).repartition(3)
    got = sorted(map(tuple, collocations.mine(df, least_count=least, top=top).collect()))
    assert got == plain_phrases(rows, least, 80, top)
    assert {x[0] for x in got} >= {"en", "und"}


def test_collocations_take_texts_in_small_batches(spark):
    df = spark.range(0, 400, 1, 1).selectExpr("'en' as lang", "repeat(concat('w', id, ' '), 4000) as text").localCheckpoint()
    collocations.relations(df, max_words=1)

    def size(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    assert max(r["n"] for r in df.mapInArrow(size, "n bigint").collect()) < 3_000_000


def test_counts_are_added_up_in_bounded_parts(spark, monkeypatch):
    """In workers up to ``HELD`` counts at a time, then from sorted rows, whichever batches these come in; Spark holds no table of groups."""
    r = random.Random(3)
    rows = [("en", r.choice("abcde"), None, r.randint(1, 9)) for _ in range(150)] + [("de", "a", None, 2), (None, None, 2**63 - 1, 5), (None, None, -(2**63), 7)]
    rows += [(None, None, r.randint(-8, 8), r.randint(1, 9)) for _ in range(400)]
    r.shuffle(rows)
    want = Counter()
    for *group, n in rows:
        want[tuple(group)] += n

    monkeypatch.setattr(collocations, "HELD", 40)
    parts = []
    for keyed, summed in ((False, collocations._summed_phrases), (True, collocations._summed_keys)):
        own = [dict(zip(collocations.COUNTS.names, x, strict=True)) for x in rows if (x[0] is None) == keyed]
        sums = collocations.Sums(summed)
        for s in range(0, len(own), 7):
            parts += sums.add(pa.RecordBatch.from_pylist(own[s : s + 7], collocations.COUNTS))
            assert sums.rows < 40 and sum(b.num_rows for b in sums.batches) == sums.rows
        parts += sums.rest()
    found = [tuple(x.values()) for p in parts for x in p.to_pylist()]
    assert len(found) < len(rows) / 2

    found.sort(key=lambda x: (x[2] is not None, x[2] or 0, x[0] or "", x[1] or ""))
    for size in (1, 2, 1000):
        own = [dict(zip(collocations.COUNTS.names, x, strict=True)) for x in found]
        batches = [pa.RecordBatch.from_pylist(own[s : s + size], collocations.COUNTS) for s in range(0, len(own), size)]
        got = [tuple(x.values()) for b in collocations._added(iter([batches[0].slice(0, 0), *batches])) for x in b.to_pylist()]
        assert len(got) == len(want) and {x[:3]: x[3] for x in got} == want
    assert list(collocations._added(iter([]))) == []

    df = spark.createDataFrame([("en", b"a b a b")], "lang string, text binary")
    plan = collocations._count(df, 1, collocations.marked_runs, True)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_runs_are_stored_in_cells(monkeypatch):
    words = collocations.Words(collocations.marked_text([b"a b. c d e. f. g h i j k l. m n. o"]))
    found = collocations.Occurrences(words, 2)
    whole = found.runs(np.ones(len(found.count), bool))
    monkeypatch.setattr(collocations, "CELL", 4)
    cells = found.runs(np.ones(len(found.count), bool))
    assert len(whole) == 1 and len(cells) > 2
    runs = lambda cells: [x.strip() for x in collocations.marked_runs(cells).split(b"\xff") if x.strip()]
    assert runs(cells) == runs(whole) == [b"a b", b"c d e", b"g h i j k l", b"m n"]


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).collect() == []
    assert collocations.mine(spark.createDataFrame([("en", None), (None, "")], "lang string, text string"), least_count=1).collect() == []


def test_counts_pass_64_bits(spark):
    n = 10**14
    rows = [("en", "a", 1, n), ("en", "b", 1, n + 1), ("en", "a b", 2, n - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, k int, n bigint")).first()
    assert got["score"] == 2_000_000 * (n - 1) // (2 * n + 1)


def test_rare_phrases_let_through_change_nothing(spark, monkeypatch):
    """A full bitmap lets every phrase through; the counts decide."""
    rows = [("en", "one two three four five six"), ("en", "one two three, six seven")] * 4 + [("en", "four five one two")]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = collocations.mine(df, least_count=5).collect()
    monkeypatch.setattr(collocations, "_bitmap", lambda keys: np.full(1024, 2**64 - 1, np.uint64))
    assert collocations.mine(df, least_count=5).collect() == want == [tuple(x) for x in plain_phrases(rows, 5, 80, 2000)]


# ---------------------------------------------------------------- archives


def pages_frame(spark):
    r = random.Random(3)
    long = ["".join(r.choice("abcdefé<>\r\n ") for _ in range(1500)) for _ in range(4)]
    rows = [(i, f"http://a.example/{i}?q=é x\r\ny", r.choice([*long, "short", "short", f"own {i}"])) for i in range(40)]
    rows += [(100, None, None), (101, "http://b.example/", ""), (102, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (103, "u", "\r\n\r\n" * 600)]
    rows += [(200, "u", long[0]), (200, "u", long[0]), (None, "u", long[0]), (None, None, "z" * 1000), (None, None, "z" * 1000), (7, "u", "z" * 999)]
    rows.append((300, "u", "y" * 300_000))
    return rows, spark.createDataFrame([(*x, "w", 1, "q") for x in rows], "page_id bigint, url string, html string, _key string, archive int, offset string").repartition(3)


def plain_archive(rows, least=1000):
    kept = {}
    for i, _, body in rows:
        if len((body or "").encode()) >= least and i is not None:
            kept[body] = max(kept.get(body, i), i)
    out = []
    for i, _, body in rows:
        b = (body or "").encode()
        top = kept.get(body, i)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if top == i else "revisit", None if top == i else top))
    return sorted(out, key=repr)


def test_archives(spark, tmp_path):
    rows, df = pages_frame(spark)
    found = warc.round_trip(df, str(tmp_path), records_per_file=7)
    got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == plain_archive(rows)
    assert found.filter("payload_digest <> stored_digest").count() == 0
    # one stream a file before; members that the library reads after, at the places of the index
    for path in (tmp_path / "streams").glob("part-*"):
        data = path.read_bytes()
        stream = __import__("zlib").decompressobj(31)
        stream.decompress(data)
        assert stream.eof and not stream.unused_data
    index = {(r["archive"].rpartition("/")[2], r["offset"]): r for r in found.collect()}
    assert len(index) == len(rows)
    for path in (tmp_path / "archives").glob("part-*"):
        data = path.read_bytes()
        assert gzip.decompress(data) == b"".join(gzip.decompress(data[o : o + r["length"]]) for (name, o), r in sorted(index.items(), key=lambda x: x[0]) if name == path.name)
    some = found.filter("page_id in (100, 102, 103, 300)")
    bodies = {r["record"].partition(b"Page-Id: ")[2].partition(b"\r\n")[0]: r["record"] for r in warc.fetch(spark, f"{tmp_path}/archives", some).collect()}
    assert bodies[b"300"].endswith(b"\r\n\r\n" + b"y" * 300_000 + b"\r\n\r\n") and bodies[b"102"].count(b"WARC/1.1") == 101
    assert set(bodies) == {b"100", b"102", b"103", b"300"}


def test_archives_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "page_id string, url string, html string")
    assert warc.round_trip(none, str(tmp_path)).collect() == []


def test_long_record_gets_an_empty_member():
    record = b"WARC/1.1\r\nContent-Length: 17000000\r\n\r\n" + b"x" * 17_000_000 + b"\r\n\r\n"
    data = warc.member(record)
    assert data[-1] != 0 and warc.EMPTY_MEMBER[-1] == 0 and gzip.decompress(warc.EMPTY_MEMBER) == b""
    ((at, length, plain), *rest) = warc.members(data + warc.EMPTY_MEMBER)
    assert (at, length, plain == record, rest) == (0, len(data), True, [])


def test_streams_of_others():
    """Members or one stream, steps of any length, damaged ends."""
    one = [b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"WARC/1.0\r\ncontent-length: 0\r\nX: \r\n\r\n\r\n\r\n", b"WARC/1.1\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"]
    for data in (gzip.compress(b"".join(one)), b"".join(map(gzip.compress, one))):
        assert [r for _, r, _ in warc.records(warc.inflated(data))] == one
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(data[:-12])))
    plain = b"".join(one)
    for n in (1, 2, 7):
        assert [r for _, r, _ in warc.records(plain[i : i + n] for i in range(0, len(plain), n))] == one
    with pytest.raises(ValueError):
        list(warc.records([plain[:-3]]))


# ---------------------------------------------------------------- resampling


def plain_resample(rows, target, n, buckets, percent, least, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.LOWER))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s = Counter(b for _, t in rows for b in features(t)[1])
    t = Counter(b for x in target for b in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for d, text in rows:
        w, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    drawn = Counter()
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        drawn[(*x, rank)] += 1
        out.remove(x)
    return sorted([*drawn.elements(), *((*x, None) for x in out)], key=repr)


@pytest.mark.parametrize(("n", "percent", "least"), [(1, 10, 20), (3, 50, 5), (2, 100, 0)])
def test_resampling(spark, corpus, docs, n, percent, least):
    target = ["the of and Thorn", "Inter-ation lea42 x1", None, ""]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    rows = [*corpus, *corpus[:9]]
    df = docs.unionByName(spark.createDataFrame([(i, t, *[None] * 6) for i, t in corpus[:9]], docs.schema))
    got = importance.resample(df, bench, n=n, buckets=500, percent=percent, least_words=least)
    names = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == plain_resample(rows, target, n, 500, percent, least, 2024)


def test_resampling_of_nothing(spark, docs, no_docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(no_docs, none).collect() == []
    assert importance.resample(docs, none).count() == docs.count()


def test_drawn_documents(spark):
    """Texts of the target's kind are drawn first."""
    target = spark.createDataFrame([("apple pear plum " * 40,)], "text string")
    rows = [(i, ("apple plum pear " if i % 10 == 0 else "stone iron brick ") * 20, "keep") for i in range(200)]
    got = importance.drawn_documents(spark.createDataFrame(rows, "doc_id bigint, text string, rank string"), target).collect()
    assert len(got) == 20 and all(r["doc_id"] % 10 == 0 and r["rank"] == "keep" for r in got)
