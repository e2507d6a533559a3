"""Collocations: frequent phrases whose parts seldom occur without each other, per language.

Method (SETM): the occurrences of frequent phrases of k words are a relation sorted by piece and position. It is joined
with the occurrences of single words at the same piece and the adjacent position, the phrases of k + 1 words are
grouped and counted, and a semi-join with the frequent groups gives the relation of the next length.

The relation is stored as *runs*: maximal stretches of a piece in which every phrase of k words may be frequent, as
words in the order of piece and position. Position i + 1 of a run is the next word of position i, so the merge-join is a
shift of an array inside the task. Groups are counted by a 64-bit key of language and words, combined in the worker, so
that most of what is shuffled is two numbers, and added up after a sort, so that no task holds a table of groups. The semi-join sends a bitmap of the frequent keys (at most 2^27 bits,
16 MiB, whatever their number). Equal keys or bits may let a rare phrase through, which costs work but no result: the
pass over the next relation, which has few phrases left, counts these exactly by their text. A phrase is frequent only
if its parts are, so nothing is lost.

Scale: two passes over the texts, two over each further relation, which shrink. A hot word or language reaches its
reducer as one row per task. Tables of phrases are joined by Spark; the best of a language are taken from salted
groups first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkclean.llm.common import bounded_batches, give_back, giving_back, mix, stored

MAX_WORDS, LEAST_COUNT, COVERED, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
LEAST_BITS, MOST_BITS = 16, 27
BATCH = "2m"  # text that a worker joins at once
HELD = 1 << 20  # counts that a worker adds up at once
CELL = 8192  # words of runs in one row, or one longer run
BREAK = b"\xff"  # no byte of UTF-8 text
UNKNOWN_LANG = "und"


def byte_table() -> bytes:
    """Lower-cases A-Z, turns ends of pieces into ``BREAK`` and tabs into blanks."""
    table = bytearray(range(256))
    for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[byte] = byte + 32
    for byte in b".,;:!?\n\x0b\x0c\r":
        table[byte] = BREAK[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


def marked_text(texts: list[bytes]) -> bytes:
    """All texts as words and ``BREAK`` between pieces and texts, divided by blanks."""
    return BREAK.join([*texts, b""]).translate(byte_table()).replace(BREAK, b" \xff ")


def marked_runs(runs: list[bytes]) -> bytes:
    return b" \xff ".join(runs)


# ---------------------------------------------------------------- relations inside tasks


class Words:
    """Words of a marked text: ``codes`` in order, the text of each code, the code of a break."""

    def __init__(self, text: bytes):
        flat = pc.split_pattern(pa.array([text], pa.large_binary()), pattern=b" ").values.dictionary_encode()
        self.names, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        self.codes = codes[codes != pc.index(self.names, b"").as_py()]
        self.stop = pc.index(self.names, BREAK).as_py()


class Occurrences:
    """All runs of ``size`` words that cross no break: where they start, which are equal, how often each occurs."""

    def __init__(self, words: Words, size: int):
        self.words, self.size, codes = words, size, words.codes
        starts = np.flatnonzero(codes != words.stop)
        which, distinct = pd.factorize(codes[starts])
        for k in range(1, size):  # the merge-join: position i with position i + k of the same piece
            starts, which = (x[: np.searchsorted(starts, len(codes) - k)] for x in (starts, which))
            word = codes[starts + k]
            go_on = word != words.stop
            starts = starts[go_on]
            which, distinct = pd.factorize(which[go_on] * len(words.names) + word[go_on])
        self.starts, self.which = starts, which
        self.count = np.bincount(which, minlength=len(distinct))
        first = np.zeros(len(distinct), np.int64)
        first[which[::-1]] = starts[::-1]
        self.parts = [codes[first + k] for k in range(size)]  # of each distinct phrase

    def phrases(self) -> pa.Array:
        """Text of every distinct phrase."""
        parts = [self.words.names.take(pa.array(p)) for p in self.parts]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.string())

    def keys(self, lang: str) -> np.ndarray:
        """A 64-bit key of language and words for every distinct phrase."""
        names = self.words.names.to_numpy(zero_copy_only=False)
        own = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        key = np.full(len(self.count), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
        for part in self.parts:
            key = mix(key * np.uint64(3) + own[part])
        return key.view(np.int64)

    def runs(self, alive: np.ndarray) -> list[bytes]:
        """The words of all stretches in which every phrase is ``alive`` (by distinct phrase), marked; in cells of about
        ``CELL`` words, because writers of files hold some hundred rows."""
        codes, names = self.words.codes, self.words.names
        own = np.zeros(len(codes) + 2, bool)
        own[self.starts[alive[self.which]] + 1] = True
        edge = np.flatnonzero(own[1:] != own[:-1])
        start, length = edge[::2], edge[1::2] - edge[::2] + self.size  # words, and a break
        if not len(start):
            return []
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
        code = codes[np.minimum(at, len(codes) - 1)]
        names = pa.concat_arrays([names, pa.array([BREAK], pa.large_binary())])
        code[ends - 1] = len(names) - 1
        last = np.flatnonzero(np.diff(ends // CELL, append=ends[-1] // CELL + 1))  # runs that end a cell
        line = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[last]]), pa.int32()), names.take(pa.array(code)))
        return pc.binary_join(line, pa.scalar(b" ", pa.large_binary())).to_pylist()


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        groups.setdefault(lang, []).append(text)
    return groups


COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("key", pa.int64()), ("n", pa.int64())])


def _count(source: DataFrame, size: int, mark, longer: bool) -> DataFrame:
    """Counts of the phrases of ``size`` words by text (of size 0: of all words, as the empty phrase) and, if
    ``longer``, of the phrases of one word more by ``key``."""

    def run(batches):
        texts, keys = Sums(_summed_phrases), Sums(_summed_keys)
        for batch in batches:
            for lang, own in _by_lang(batch).items():
                words = Words(mark(own))
                if size:
                    found = Occurrences(words, size)
                    yield from texts.add(_counted(lang, found.phrases(), found.count))
                    del found  # before the next relation is built
                if longer:
                    found = Occurrences(words, size + 1)
                    if not size:
                        yield from texts.add(_counted(lang, pa.array([""]), found.count.sum(keepdims=True)))
                    found = _keyed(found.keys(lang), found.count)
                    del words  # before the keys are added up
                    yield from keys.add(found)
        yield from texts.rest()
        yield from keys.rest()
        give_back()

    groups = ["key", "lang", "phrase"]
    parts = source.mapInArrow(run, _COUNTS).repartition(*map(F.col, groups)).sortWithinPartitions(*groups)
    return parts.mapInArrow(_added, _COUNTS)


_COUNTS = "lang string, phrase string, key bigint, n bigint"


class Sums:
    """Counts of a task, added up by ``summed`` before they leave it, up to ``HELD`` at a time."""

    def __init__(self, summed):
        self.summed, self.batches, self.rows = summed, [], 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.batches.append(batch)
        self.rows += batch.num_rows
        if self.rows >= HELD:
            self.batches = [self.summed(self.batches)]
            self.rows = self.batches[0].num_rows
            if self.rows > HELD // 2:  # else what comes next would be added up too often
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        batches, self.batches, self.rows = self.batches, [], 0
        if batches:
            out = self.summed(batches) if len(batches) > 1 else batches[0]
            del batches
            for s in range(0, out.num_rows, 100_000):
                yield out.slice(s, 100_000)


def _keyed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(n), pa.string())
    return pa.RecordBatch.from_arrays([none, none, pa.array(keys), pa.array(n)], schema=COUNTS)


def _summed_keys(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    keys = np.concatenate([b.column("key").to_numpy() for b in batches])
    order = np.argsort(keys)
    keys, n = keys[order], np.concatenate([b.column("n").to_numpy() for b in batches])[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else order
    return _keyed(keys[first], np.add.reduceat(n, first)) if len(keys) else batches[0]


def _summed_phrases(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    found = pa.Table.from_batches(batches).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    lang, phrase, n = (found[c].combine_chunks() for c in ("lang", "phrase", "n_sum"))
    return pa.RecordBatch.from_arrays([lang, phrase, pa.nulls(len(n), pa.int64()), n], schema=COUNTS)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group of sorted rows."""
    last = None  # group of the batch before, which may go on
    for batch in batches:
        batch = batch.cast(COUNTS) if last is None else pa.concat_batches([last, batch.cast(COUNTS)])
        rows = batch.num_rows
        if not rows:
            continue
        new = np.zeros(rows, bool)
        new[0] = True
        for c in ("lang", "phrase", "key"):
            one, other = batch.column(c).slice(0, rows - 1), batch.column(c).slice(1)
            if batch.column(c).null_count == rows:
                continue
            differs = pc.or_(pc.fill_null(pc.not_equal(one, other), False), pc.xor(one.is_null(), other.is_null()))
            new[1:] |= differs.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        found = batch.take(pa.array(first)).set_column(3, COUNTS.field("n"), pa.array(np.add.reduceat(batch.column("n").to_numpy(), first)))
        last = found.slice(found.num_rows - 1)
        if found.num_rows > 1:
            yield found.slice(0, found.num_rows - 1)
    if last is not None:
        yield last
    give_back()


def _counted(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang], pa.string()))
    return pa.RecordBatch.from_arrays([langs.cast(pa.string()), phrases, pa.nulls(len(n), pa.int64()), pa.array(n)], schema=COUNTS)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the frequent keys: 16 a key, 2^16 to 2^27 in all, so at most 16 MiB reach the driver."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    found = keys.select(F.col("key").bitwiseAND((1 << bits) - 1).alias("s"))
    found = found.select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("b"))
    words = np.zeros(1 << (bits - 6), np.int64)
    rows = found.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return words.view(np.uint64)


def _semi_join(source: DataFrame, size: int, mark, keys: DataFrame) -> DataFrame:
    """Runs of the occurrences in ``source`` whose phrases of ``size`` words may be among ``keys``."""
    shared = source.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def run(batches):
        bitmap = shared.value
        mask = len(bitmap) * 64 - 1
        for batch in batches:
            langs, out = [], []
            for lang, texts in _by_lang(batch).items():
                found = Occurrences(Words(mark(texts)), size)
                slot = found.keys(lang) & mask
                alive = (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
                cells = found.runs(alive)
                langs += [lang] * len(cells)
                out += cells
            if langs:
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(out, pa.binary())], ["lang", "text"])

    return source.mapInArrow(giving_back(run), "lang string, text binary")


# ---------------------------------------------------------------- relations in Spark


def relations(
    docs: DataFrame, max_words: int = MAX_WORDS, least_count: int = LEAST_COUNT, lang_col: str = "lang", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``phrase``, ``k`` words, ``n``) of all phrases of up to ``max_words`` words that occur ``least_count``
    times; (``lang``, ``n``) with all word occurrences of every language."""
    bounded_batches(docs.sparkSession, rows=20_000, size=BATCH)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG))
    own = docs.select(lang.alias("lang"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text"))
    frequent = F.col("n") >= least_count
    counts = stored(_count(own, 0, marked_text, longer=True).filter(frequent | (F.col("phrase") == "")), "setm-words")
    totals = counts.filter("phrase = '' and n > 0").select("lang", "n")
    found, source, mark = [], own, marked_text
    for k in range(1, max_words + 1):
        source = stored(_semi_join(source, k, mark, counts.filter("key is not null")), f"setm-runs-{k}")
        mark = marked_runs
        counts = stored(_count(source, k, mark, longer=k < max_words).filter(frequent), f"setm-groups-{k}")
        found.append(counts.filter("phrase is not null").withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, found).select("lang", "phrase", "k", "n"), totals


def _exact(value: str) -> Column:
    return F.col(value).cast("decimal(20,0)")


def scored(phrases: DataFrame, scale: int = SCALE) -> DataFrame:
    """Candidates (two words or more) with ``a``, the counts ``l`` and ``r`` of their weakest cut, and ``score``."""
    cuts = phrases.filter("k > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("_cut"))
    part = lambda start, size: F.concat_ws(" ", F.slice("_w", start, size))
    cuts = cuts.select("lang", "phrase", "a", "_cut", part(1, F.col("_cut")).alias("_first"), part(F.col("_cut") + 1, F.size("_w") - F.col("_cut")).alias("_rest"))
    first = phrases.select("lang", F.col("phrase").alias("_first"), F.col("n").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r"))
    both = cuts.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"])
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    both = both.select("lang", "phrase", "a", "_cut", "l", "r", score.cast("bigint").alias("score"))
    least = both.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "_cut")).alias("_best"))
    return least.select("lang", "phrase", "a", "_best.*")


def covered(phrases: DataFrame, percent: int = COVERED) -> DataFrame:
    """(``lang``, ``phrase``) of candidates that lie in a longer candidate with ``percent`` of their count or more."""
    longer = phrases.filter("k > 2").select("lang", F.col("n").alias("_long"), F.col("k").alias("_k"), F.split("phrase", " ").alias("_w"))
    longer = longer.select("lang", "_long", "_k", "_w", F.explode(F.sequence(F.lit(2), F.col("_k") - 1)).alias("_size"))
    inner = longer.select("lang", "_long", F.explode(F.transform(F.sequence(F.lit(1), F.col("_k") - F.col("_size") + 1), lambda i: F.concat_ws(" ", F.slice("_w", i, F.col("_size"))))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("_long").alias("_long"))
    both = phrases.select("lang", "phrase", "n").join(most, ["lang", "phrase"])
    return both.filter(_exact("_long") * 100 >= _exact("n") * percent).select("lang", "phrase")


def mine(
    docs: DataFrame, max_words: int = MAX_WORDS, least_count: int = LEAST_COUNT, percent: int = COVERED, top: int = TOP,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of every language.

    A null language is ``und``, a null text is empty, repeated rows count again, an empty table gives no rows; columns
    of other names are not read. Ties in score go to the larger count, then to the phrase that sorts first by bytes.
    """
    phrases, totals = relations(docs, max_words, least_count, lang_col, text_col)
    kept = scored(phrases).join(covered(phrases, percent), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
