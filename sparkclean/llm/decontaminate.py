"""Benchmark decontamination by greedy string tiling.

The benchmark is a stated query set; its n-grams of ``min_match`` tokens travel to every task in blocks of bounded
size. A document that shares seeds with an item is tiled against it: the longest common run of unmarked tokens is
found by Karp-Rabin hashes with a search over the length, all non-overlapping runs of that length are marked, and so
on down to ``min_match``. The share of the item that is marked decides, so passages cut up and reordered count too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.llm.common import SMALL_BATCH, bounded_batches, giving_back, gram_hashes, lists_of, stored

MIN_MATCH = 4
COVERAGE = 0.6
BLOCK_TOKENS = 2_000_000  # benchmark tokens that one block may hold: 16 MB
# ASCII other than letters and digits, and the common punctuation blocks beyond ASCII
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{80}-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+"
_MATCH = T.ArrayType(
    T.StructType([
        T.StructField("item", T.StringType()), T.StructField("matched", T.IntegerType()),
        T.StructField("item_tokens", T.IntegerType()), T.StructField("coverage", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ])
)
_MATCH_ARROW = pa.list_(
    pa.struct([
        ("item", pa.string()), ("matched", pa.int32()), ("item_tokens", pa.int32()), ("coverage", pa.float64()),
        ("spans", pa.list_(pa.list_(pa.int32()))),
    ])
)


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


@dataclass
class Items:
    """A block of benchmark items, indexed by the hash of their seeds."""

    names: list[str]
    tokens: list[np.ndarray]
    min_match: int
    coverage: float

    def __post_init__(self):
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # seed length -> sorted hashes, items
        self.seeds: list[np.ndarray] = [gram_hashes(t, min(self.min_match, len(t))) if len(t) else t for t in self.tokens]
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, t in enumerate(self.tokens):
            if len(t):
                size = min(self.min_match, len(t))
                by_size.setdefault(size, []).append((np.unique(self.seeds[k]), k))
        for size, rows in by_size.items():
            grams = np.concatenate([g for g, _ in rows])
            owner = np.concatenate([np.full(len(g), k) for g, k in rows])
            order = np.argsort(grams, kind="stable")
            self.index[size] = (grams[order], owner[order])

    def candidates(self, values: np.ndarray, offsets: np.ndarray):
        """(document, item, seed length, seed positions) of every pair that may reach the coverage."""
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for size, (grams, owner) in self.index.items():
            found = gram_hashes(values, size)
            low = np.searchsorted(grams, found, "left")
            hit = np.flatnonzero(grams[np.minimum(low, len(grams) - 1)] == found)
            hit = hit[row_of[hit] == row_of[hit + size - 1]] if len(hit) else hit
            if not len(hit):
                continue
            many = np.searchsorted(grams, found[hit], "right") - low[hit]
            at = np.repeat(hit, many)
            item = owner[np.repeat(low[hit], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
            pair = row_of[at] * len(self.tokens) + item
            order = np.argsort(pair, kind="stable")
            pair, at = pair[order], at[order]
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(pair)], strict=True):
                row, k = divmod(int(pair[s]), len(self.tokens))
                # every marked token of the item lies in a seed that the document holds; a seed may recur in the item
                places = np.flatnonzero(np.isin(self.seeds[k], found[at[s:e]]))
                if size + np.minimum(np.diff(places), size).sum() >= self.coverage * len(self.tokens[k]):
                    yield row, k, size, at[s:e] - offsets[row]


def _longest(a: np.ndarray, b: np.ndarray, least: int, most: int) -> int:
    """Length of the longest common run, between ``least`` and ``most``; 0 if there is none."""
    if not len(np.intersect1d(gram_hashes(a, least), gram_hashes(b, least))):
        return 0
    low, high = least, most
    while low < high:
        mid = (low + high + 1) // 2
        if len(np.intersect1d(gram_hashes(a, mid), gram_hashes(b, mid))):
            low = mid
        else:
            high = mid - 1
    return low


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, length) of the marked runs, longest first."""
    a, b = doc.copy(), item.copy()
    fresh = np.uint64(0)  # marked tokens become values that occur once; a clash with a hash has odds of 2^-64
    out, most = [], min(len(a), len(b))
    while most >= least:
        size = _longest(a, b, least, most)
        if not size:
            break
        ga, gb = gram_hashes(a, size), gram_hashes(b, size)
        where: dict[int, list[int]] = {}
        for j in range(len(gb) - 1, -1, -1):
            where.setdefault(int(gb[j]), []).append(j)
        used, end = np.zeros(len(b), bool), 0
        for i in np.flatnonzero(np.isin(ga, gb)):
            if i < end:
                continue
            free = where.get(int(ga[i]), [])
            while free and (used[free[-1]] or used[free[-1] + size - 1]):
                free.pop()
            if free:
                j = free.pop()
                used[j : j + size] = True
                out.append((int(i), j, size))
                for x in (a[i : i + size], b[j : j + size]):
                    x[:] = np.arange(size, dtype=np.uint64) + fresh + np.uint64(1)
                    fresh += np.uint64(size)
                end = i + size
        most = size
    return out


def _regions(tokens: np.ndarray, seeds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that lie in a seed, with a gap between separate stretches, and their positions (-1 for a gap)."""
    where = np.unique((seeds[:, None] + np.arange(size)).ravel())
    cut = np.flatnonzero(np.diff(where) > 1) + 1
    position = np.insert(where, cut, -1)
    out = tokens[np.maximum(position, 0)].copy()
    gap = position < 0
    out[gap] = np.uint64(0) - np.arange(1, gap.sum() + 1, dtype=np.uint64)
    return out, position


def _matches(items: Items, values: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    for row, k, size, seeds in items.candidates(values, offsets):
        region, position = _regions(values[offsets[row] : offsets[row + 1]], seeds, size)
        tiles = tile(region, items.tokens[k], size)
        marked, total = sum(t[2] for t in tiles), len(items.tokens[k])
        if marked >= items.coverage * total:
            spans = sorted([int(position[i]), n] for i, _, n in tiles)
            out[row].append({"item": items.names[k], "matched": marked, "item_tokens": total, "coverage": marked / total, "spans": spans})
    return out


def with_matches(docs: DataFrame, items: Items, text_col: str = "text", name: str = "matches") -> DataFrame:
    """All columns of ``docs`` and an array of the items of one block that it holds. Rows are judged one by one."""
    bounded_batches(docs.sparkSession, size=SMALL_BATCH)
    kept = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*kept).withColumn("_tokens", token_hashes(F.col(kept[docs.columns.index(text_col)])))
    schema = T.StructType([*docs.toDF(*kept).schema.fields, T.StructField("_matches", _MATCH)])

    def run(batches):
        for batch in batches:
            found = _matches(items, *lists_of(batch.column("_tokens")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _MATCH_ARROW)], [*kept, "_matches"])

    return own.mapInArrow(giving_back(run), schema).toDF(*docs.columns, name)


def item_blocks(
    benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", min_match: int = MIN_MATCH,
    coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS,
):
    """Blocks of benchmark items, one at a time on the driver. Null ids or texts and texts without a token match
    nothing; an item shorter than ``min_match`` tokens must occur whole; repeated rows count once."""
    own = (
        benchmark.filter(F.col(item_col).isNotNull())
        .select(F.col(item_col).cast("string").alias("_item"), token_hashes(F.col(text_col)).alias("_tokens"))
        .filter(F.size("_tokens") > 0)
        .distinct()
    )
    total = own.agg(F.sum(F.size("_tokens"))).first()[0] or 0
    blocks = -(-total // block_tokens)
    for b in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).orderBy("_item", "_tokens").collect()
        yield Items([r["_item"] for r in rows], [np.array(r["_tokens"], np.int64).view(np.uint64) for r in rows], min_match, coverage)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per document and benchmark item of which the document holds at least ``coverage``: the ids,
    ``matched`` and ``item_tokens``, ``coverage`` and ``spans`` (token position and length in the document).

    Null and empty texts hold nothing; an empty table on either side gives no rows; repeated documents give a row
    each. Tokens are lower-cased runs of letters and digits of the whole text.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    parts = []
    for items in item_blocks(benchmark, item_col, item_text_col, min_match, coverage, block_tokens):
        found = (
            with_matches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), items, "_text")
            .select("_id", F.inline("matches"))
            .select(F.col("_id").alias(id_col), F.col("item").cast(item_kind).alias(item_col), "matched", "item_tokens", "coverage", "spans")
        )
        parts.append(found)
        if len(items.names) and sum(map(len, items.tokens)) * 2 > block_tokens:
            parts[-1] = stored(found, "decontaminate")  # large blocks are not kept on the driver together
    if not parts:
        fields = [T.StructField(id_col, kind), T.StructField(item_col, item_kind), *_MATCH.elementType.fields[1:]]
        return spark.createDataFrame([], T.StructType(fields))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their columns; rows are judged in place, without a join."""
    for items in item_blocks(benchmark, **options):
        docs = with_matches(docs, items, text_col, "_found").filter(F.size("_found") == 0).select(*docs.columns)
    return docs
