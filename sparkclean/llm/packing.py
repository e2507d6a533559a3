"""Best-fit packing of tokenised documents by exact complements.

The plan needs only how many pieces of each length there are: at most ``capacity`` numbers, whatever the corpus. For
the longest length left, the gap is filled exactly by one, two or three available lengths whose sum is indexed; what
finds no exact complement is packed best-fit, on counts. Pieces get a rank within their length by salted groups and
take the place that the plan has for that rank.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclean.llm.common import SMALL_BATCH, Remembered, bounded_batches, giving_back, stored, worker_cache

CAPACITY = 4096
CACHED_BYTES = 16_000_000  # of a generation of words
CACHED_LENGTH = 64
TOGETHER = 1_000_000  # characters of texts that are divided into words at once
LATIN_END = "\u0250"  # letters below it are their own normal form
# a sign after a Latin letter or digit; an apostrophe may belong to the letters after it
SIGNS = r"[!-&(-/:-@\[-`{-~](?<=[0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f].)"
GROUP = 1000  # pieces of one length that one rank group holds on average


class WordEncoder:
    """Ids of a text by a tokenizer that drops white space: words are encoded apart and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # low Latin letters pass normalizer and splitting pattern as they are; the same model takes them without these
        self.plain = Tokenizer(self.tokenizer.model)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        suffix = self.tokenizer.model.end_of_word_suffix
        self.closes = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)  # by id: the last one of a word
        if suffix:
            self.closes[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs = re.compile(SIGNS)
        self.known = Remembered(CACHED_BYTES)

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of low Latin letters, cut apart by the ids that close a word."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
        if len(ends) != len(words) or ends[-1] != ids.nbytes:  # a vocabulary that does not mark them
            return self._library(words)
        body, ends = ids.tobytes(), ends.tolist()
        return [body[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def _library(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of words without white space: one call for all, cut apart by the offsets."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        at = np.searchsorted(np.fromiter((o[0] for o in found.offsets), np.int64, len(found)), begins) * 4
        body = np.array(found.ids, "<u4").tobytes()
        return [body[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def _encoded(self, words: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        letters: list[str] = []
        others: list[str] = []
        for w in words:
            low = w.isalpha() and w == w.lower() and (w.isascii() or max(w) < LATIN_END)
            (letters if low else others).append(w)
        for some, encode in ((letters, self._letters), (others, self._library)):
            for start in range(0, len(some), 1000):
                part = some[start : start + 1000]
                out.update(zip(part, encode(part), strict=True))
        return out

    def _parts(self, text: str) -> list[str]:
        """Parts of a text that are encoded apart: words, and in them the signs after a letter or digit.

        Letters are lower-cased, so that all spellings of a word share its ids. A text with a special string keeps its
        words, and one with letters beyond the Latin ones, whose lower case may differ, keeps its letters.
        """
        low = text.lower()
        if any(mark in low for mark in self.special):
            return text.split()
        latin = text.isascii() or (max(text) < LATIN_END and "\u0130" not in text)
        return self.signs.sub(r" \g<0>", low if latin else text).split()

    def _some(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        kinds = set().union(*parts)
        long = [w for w in kinds if len(w) > CACHED_LENGTH]
        known = self.known.fill(kinds.difference(long), lambda lost: map(self._encoded(lost).__getitem__, lost))
        if long:
            known = {w: known[w] for w in kinds.difference(long)} | self._encoded(long)
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        some: list[str] = []
        size = 0
        for t in texts:
            # the separators \x1c to \x1f divide words for Python but not for the tokenizer
            odd = any(c in t for c in "\x1c\x1d\x1e\x1f")
            if some and (odd or size + len(t) > TOGETHER):
                yield from self._some(some)
                some, size = [], 0
            if odd:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                some.append(t)
                size += len(t)
        yield from self._some(some)


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of every document.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut. A null text is empty: its one
    piece holds ``end_id`` alone. Null ids and repeated rows are kept.
    """
    bounded_batches(docs.sparkSession, rows=500, size=SMALL_BATCH)
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()
    names = ["_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encoder = worker_cache(f"words_{path}", lambda: WordEncoder(path))
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(encoder.encode(batch.column("_text").to_pylist())):
                ids += end_id.to_bytes(4, "little")
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    row.append(r), piece.append(k), start.append(s // 4), length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ], names,
            )

    return own.mapInArrow(giving_back(run), f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("_id", id_col)


# ---------------------------------------------------------------- plan


@dataclass(frozen=True)
class Plan:
    """Places by (length, rank): ``count`` pieces from ``rank`` on go to sequences ``sequence``, +1, ... at ``offset``."""

    places: list[tuple[int, int, int, int, int]]  # length, rank, count, sequence, offset
    sequences: int


def _pair(gap: int, have: np.ndarray, top: int) -> tuple[int, int] | None:
    """Two available lengths with sum ``gap``, the larger as long as possible but at most ``top``."""
    low, high = (gap + 1) // 2, min(gap - 1, top)
    if low > high:
        return None
    hit = (have[low : high + 1] > 0) & (have[gap - high : gap - low + 1][::-1] > 0)
    if gap % 2 == 0 and hit[0] and have[low] < 2:
        hit[0] = False
    found = np.flatnonzero(hit)
    return (int(low + found[-1]), int(gap - low - found[-1])) if len(found) else None


def _complement(gap: int, have: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that fill ``gap`` exactly."""
    if have[gap] > 0:
        return (gap,)
    if two := _pair(gap, have, gap):
        return two
    for first in np.flatnonzero(have[1:gap])[::-1] + 1:
        first = int(first)
        if 3 * first < gap:
            break
        have[first] -= 1
        two = _pair(gap - first, have, first)
        have[first] += 1
        if two:
            return (first, *two)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``counts[length]`` pieces of each length (1 to ``capacity``) into as few sequences as it can."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    rank = np.zeros(capacity + 1, np.int64)
    places: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(lengths, offset: int, first: int, n: int) -> None:
        for length in lengths:
            places.append((length, int(rank[length]), n, first, offset))
            rank[length] += n
            offset += length

    left: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while have[length]:
            n = int(have[length])
            if length == capacity:
                combination: tuple[int, ...] | None = ()
            else:
                have[length] -= 1
                combination = _complement(capacity - length, have)
                have[length] += 1
            if combination is None:
                left.append((length, n))
                have[length] = 0
                break
            own = (length, *combination)
            need = {x: own.count(x) for x in own}
            n = min(int(have[x]) // k for x, k in need.items())
            for x, k in need.items():
                have[x] -= n * k
            place(own, 0, sequences, n)
            sequences += n
    # best fit of the rest: groups of equal sequences by the gap that they have left
    gaps: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def add(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in groups:
                gaps.insert(bisect_left(gaps, gap), gap)
                groups[gap] = []
            groups[gap].append((first, n))

    for length, n in left:
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                # as many as fit in one new sequence go into each
                each = min(n, capacity // length)
                full = max(1, n // each)
                for k in range(each):
                    place((length,), k * length, sequences, full)
                add(capacity - each * length, sequences, full)
                sequences += full
                n -= each * full
                continue
            gap = gaps[at]
            first, size = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            each = min(gap // length, max(1, n // size))
            used = min(size, n // each)
            if used < size:
                add(gap, first + used, size - used)
            for k in range(each):
                place((length,), capacity - gap + k * length, first, used)
            add(gap - each * length, first, used)
            n -= each * used
    return Plan(places, sequences)


# ---------------------------------------------------------------- assignment


def pack(pieces_df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of ``pieces_df`` (with ``length``) and ``sequence_id``, ``offset``.

    A length that many pieces share is ranked in groups of about ``GROUP`` pieces; the only data on the driver are
    the counts per length and the plan. An empty table gives no rows.
    """
    spark = pieces_df.sparkSession
    kept = pieces_df.columns
    own = stored(pieces_df, "pieces")  # in the batches that pieces() asked for
    bounded_batches(spark)
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity)
    places = np.array(sorted(made.places), np.int64).reshape(-1, 5)
    keys = places[:, 0] * (1 << 40) + places[:, 1]
    groups = np.ones(capacity + 1, np.int64)
    for length, n in counts.items():
        groups[length] = -(-n // GROUP)
    split = F.element_at(F.array(*[F.lit(int(x)) for x in groups]), (F.col("length") + 1).cast("int")) if len(counts) else F.lit(1)
    salted = own.withColumn("_salt", F.pmod(F.xxhash64(*kept), split))
    at = Window.partitionBy("length", "_salt").orderBy(*kept)
    sizes = stored(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "piece-groups")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(at) - 1)
        .join(starts, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .select(*kept, "_rank")
    )
    schema = own.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = places[np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1]
            columns = [*batch.columns[:-1], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)
