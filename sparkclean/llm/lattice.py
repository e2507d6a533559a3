"""Language-model scores by the marginal likelihood of a subword lattice.

Every segmentation of a word into pieces of an existing vocabulary is a path of a lattice; a path weighs the product
of its pieces, and the forward recursion in log space sums all paths. Since no piece spans a word boundary, a text is
the product of its words, so the recursion runs once for every distinct word of the corpus. The vocabulary file
ranks its pieces; these ranks are the prior weights, and passes of expected counts over all distinct training words
(forward and backward) turn them into piece probabilities, fitted to what unseen words look like. A known word is itself one more path, weighed by
its training count less a discount; the pieces share what the discounts leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import ascii_lower, batches_of, bounded_batches, fold_of, lists_of, stored, word_hashes, words, worker_cache

BROADCAST_WORDS = 200_000  # frequent words whose scores travel to every task; all others are joined
PASSES = 2  # of expected counts
WORD_BYTES = 2_000_000  # of a table of words that the lattice takes at once
PRIOR = 1000.0  # pieces that the ranks of the vocabulary file count for
START = chr(0x2581)  # begins a word in the vocabulary file
_P = np.uint64(0x9E3779B97F4A7C15)
_NONE = -np.inf


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece file that can occur in a word, and their prior by rank; then the 256 bytes.

    The last 256 entries stand for bytes: a character without a piece is the sequence of its UTF-8 bytes.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and START not in piece[1:]:
            found[piece] = model.get_score(i)
    found.setdefault(START, -1.0)
    pieces = list(found)
    rank = np.array([-found[p] for p in pieces] + [float(len(pieces))] * 256)
    prior = 1 / (10 + np.clip(rank, 0, None))
    return pieces, prior / prior.sum()


class Lattice:
    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        hashes = np.zeros(self.size, np.uint64)
        with np.errstate(over="ignore"):
            for k, p in enumerate(pieces):
                h = np.uint64(0)
                for c in p:
                    h = h * _P + np.uint64(ord(c) + 1)
                hashes[k] = h
            self.powers = [np.uint64(1)]
            for _ in range(self.longest):
                self.powers.append(self.powers[-1] * _P)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def _arcs(self, codes: np.ndarray, log_p: np.ndarray):
        """For each arc length: piece numbers (-1: none) and log weights, by word and start; then log weights of
        single characters as bytes."""
        n, size = codes.shape
        arcs = []
        with np.errstate(over="ignore"):
            prefix = np.zeros((size + 1, n), np.uint64)
            for k in range(size):
                prefix[k + 1] = prefix[k] * _P + (codes[:, k].astype(np.uint64) + np.uint64(1))
            for length in range(1, min(self.longest, size) + 1):
                h = prefix[length:] - prefix[:-length] * self.powers[length]
                at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
                piece = np.where(self.hashes[at] == h, self.order[at], -1)
                arcs.append((piece, np.where(piece >= 0, log_p[piece], _NONE)))
        kinds, back = np.unique(codes, return_inverse=True)
        spelled = np.array([sum(log_p[self.size + b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in kinds])
        return arcs, spelled[back].reshape(codes.shape).T

    def _forward(self, arcs, spelled):
        size, n = spelled.shape
        alpha = np.full((size + 1, n), _NONE)
        alpha[0] = 0
        for j in range(1, size + 1):
            terms = [alpha[j - 1] + spelled[j - 1]]
            terms += [alpha[j - k] + weight[j - k] for k, (_, weight) in enumerate(arcs[:j], 1)]
            alpha[j] = np.logaddexp.reduce(terms)
        return alpha

    def _backward(self, arcs, spelled):
        size, n = spelled.shape
        beta = np.full((size + 1, n), _NONE)
        beta[size] = 0
        for i in range(size - 1, -1, -1):
            terms = [beta[i + 1] + spelled[i]]
            terms += [beta[i + k] + weight[i] for k, (_, weight) in enumerate(arcs[: size - i], 1)]
            beta[i] = np.logaddexp.reduce(terms)
        return beta

    @staticmethod
    def by_length(texts: list[str], most: int = 4_000_000):
        """(rows, code points) of words of one length, in chunks of bounded size."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(sizes, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if len(rows):
                step = max(1, most // (32 * (int(sizes[rows[0]]) + 1)))
                for s in range(0, len(rows), step):
                    some = rows[s : s + step]
                    joined = "".join(START + texts[r] for r in some)
                    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), -1)
                    yield some, codes

    def log10_marginal(self, texts: list[str], log_p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts))
        for rows, codes in self.by_length(texts):
            arcs, spelled = self._arcs(codes, log_p)
            out[rows] = self._forward(arcs, spelled)[-1]
        return out / math.log(10)

    def expected(self, texts: list[str], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece and byte over all segmentations of the words."""
        out = np.zeros(self.size + 256)
        for rows, codes in self.by_length(texts):
            arcs, spelled = self._arcs(codes, log_p)
            alpha, beta = self._forward(arcs, spelled), self._backward(arcs, spelled)
            total, many = alpha[-1], counts[rows]
            for k, (piece, weight) in enumerate(arcs, 1):
                share = np.exp(alpha[: len(alpha) - k] + weight + beta[k:] - total) * many
                used = piece >= 0
                out[: self.size] += np.bincount(piece[used], share[used], self.size)
            share = np.exp(alpha[:-1] + spelled + beta[1:] - total) * many
            kinds, back = np.unique(codes.T, return_inverse=True)
            for c, s in zip(kinds, np.bincount(back.ravel(), share.ravel(), len(kinds)), strict=True):
                if s > 1e-9:
                    for b in chr(c).encode("utf-8", "surrogatepass"):
                        out[self.size + b] += s
        return out


def gathered(batches: Iterable[pa.RecordBatch], most: int = WORD_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of words joined up to ``most`` bytes: the lattice works on arrays of words of one length."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def _piece_counts(types: DataFrame, path: str, log_p: np.ndarray) -> np.ndarray:
    """Expected counts over all distinct training words: one vector of vocabulary size per task, summed by Spark."""

    def run(batches):
        lattice = worker_cache(f"lattice_{path}", lambda: Lattice(vocabulary(path)[0]))
        total = np.zeros(lattice.size + 256)
        for batch in gathered(batches):
            total += lattice.expected(batch.column("word").to_pylist(), np.ones(len(batch)), log_p)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

    found = types.filter("count > 0").select("word").mapInArrow(run, "piece int, n double")
    out = np.zeros(len(log_p))
    for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most one row per piece
        out[r["piece"]] = r["n"]
    return out


def score(
    docs: DataFrame, path: str, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text",
    passes: int = PASSES, broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``lattice_score``.

    Learns from all documents outside fold ``held_out``. ``base_score`` is the additive word model, ``lattice_score``
    the marginal of the pieces alone, ``score`` the marginal with known words as further paths; all are log10
    probabilities of words and one end per document. A null text is empty: one token, the end. Null ids and repeated
    rows are kept; without a training document all counts are zero and the pieces have their prior weights.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces, prior = vocabulary(path)
    own = docs.select(
        F.col(id_col).alias("_id"), (fold_of(F.col(id_col), folds) == held_out).alias("_held"),
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
    )
    types = stored(
        own.select(F.explode(words(F.col("_text"))).alias("word"), F.when(F.col("_held"), 0).otherwise(1).alias("_n"))
        .groupBy("word")
        .agg(F.sum("_n").alias("count"), F.count("*").alias("all")),
        "lm-words",
    )
    sums = types.agg(
        F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v"),
        F.count_if(F.col("count") == 1).alias("v1"), F.count_if(F.col("count") == 2).alias("v2"),
    ).first()
    ends = own.filter("not _held").count()
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)

    starts = np.array([p.startswith(START) for p in pieces] + [False] * 256)
    log_p, end_share = np.log(prior), 0.0
    for _ in range(passes if n else 0):
        counts = _piece_counts(types, path, log_p)
        smooth = counts + PRIOR * prior
        log_p = np.log(smooth / (smooth.sum() + ends))
        end_share = ends / (smooth[starts].sum() + ends)
    end_share = end_share or 0.5
    # absolute discounting: what is taken from each known word is what the pieces share
    ones, twos = sums["v1"] or 0, sums["v2"] or 0
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    spare = discount * v / n if n else 1.0

    def log_base(count):
        return F.log10((count + F.lit(0.5)) / F.lit(n + 0.5 * (v + 1)))

    def run_types(batches):
        lattice = worker_cache(f"lattice_{path}", lambda: Lattice(vocabulary(path)[0]))
        for batch in gathered(batches):
            count = batch.column("count").to_numpy().astype(float)
            sub = lattice.log10_marginal(batch.column("word").to_pylist(), log_p)
            rest = sub + math.log10(spare)
            direct = np.log10(np.maximum(count - discount, 1e-300) / max(n, 1))
            both = np.logaddexp(direct * math.log(10), rest * math.log(10)) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.where(count > 0, both, rest)), pa.array(sub)],
                ["hash", "count", "all", "model", "sub"],
            )

    scored = stored(
        types.select("word", F.xxhash64("word").alias("hash"), "count", "all").mapInArrow(
            run_types, "hash bigint, count bigint, all bigint, model double, sub double"
        ),
        "lm-scores",
    ).withColumn("base", log_base(F.col("count")))
    # the frequent words: a count above which there are at most so many
    level = F.floor(F.log2("all") * 4).cast("int")
    least, total = None, 0
    for r in sorted(scored.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > broadcast_words:
            break
        least = r["level"]
    top = scored.filter(level >= least if least is not None else F.lit(False)).select("hash", "count", "base", "model", "sub").toPandas()
    top = top.sort_values("hash")
    keys = top["hash"].to_numpy(np.int64)
    table = np.stack([(top["count"] > 0).to_numpy(float), *(top[c].to_numpy(float) for c in ("base", "model", "sub"))]) if len(top) else np.zeros((4, 0))

    kind = own.schema["_id"].dataType.simpleString()
    names = ["_row", "_id", "_held", "_tokens", "_known", "_base", "_model", "_sub", "hash"]

    def run_docs(batches):
        for batch in batches:
            values, offsets = lists_of(batch.column("_words"))
            values = values.view(np.int64)
            rows = len(offsets) - 1
            row_of = np.repeat(np.arange(rows), np.diff(offsets))
            at = np.searchsorted(keys, values)
            hit = keys[np.minimum(at, len(keys) - 1)] == values if len(keys) else np.zeros(len(values), bool)
            sums = [np.bincount(row_of[hit], t[at[hit]], rows).astype(float) for t in table]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"), batch.column("_id"), batch.column("_held"), pa.array(np.diff(offsets)),
                    pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:]), pa.nulls(rows, pa.int64()),
                ], names,
            )
            rest = np.stack([row_of[~hit], values[~hit]], 1)
            pair, many = np.unique(rest, axis=0, return_counts=True) if len(rest) else (rest, np.zeros(0, np.int64))
            ids = batch.column("_row").to_numpy()
            columns = {"_row": ids[pair[:, 0]], "_id": [None] * len(pair), "_held": [None] * len(pair), "_tokens": many}
            columns |= {c: np.zeros(len(pair), np.int64 if c == "_known" else float) for c in names[4:8]} | {"hash": pair[:, 1]}
            types_of = [pa.int64(), batch.schema.field("_id").type, pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()]
            yield from batches_of(columns, pa.schema(list(zip(names, types_of, strict=True))))

    parts = stored(
        own.select(F.monotonically_increasing_id().alias("_row"), "_id", "_held", word_hashes(F.col("_text")).alias("_words")).mapInArrow(
            run_docs, f"_row bigint, _id {kind}, _held boolean, _tokens bigint, _known bigint, _base double, _model double, _sub double, hash bigint"
        ),
        "lm-parts",
    )
    whole = parts.filter("hash is null").drop("hash")
    rest = (
        parts.filter("hash is not null")
        .select("_row", "hash", "_tokens")
        .join(scored.select("hash", "count", "base", "model", "sub"), "hash")
        .select(
            "_row", F.lit(None).cast(kind).alias("_id"), F.lit(None).cast("boolean").alias("_held"), F.lit(0).cast("long").alias("_tokens"),
            F.when(F.col("count") > 0, F.col("_tokens")).otherwise(0).alias("_known"),
            *((F.col("_tokens") * F.col(c)).alias(f"_{c}") for c in ("base", "model", "sub")),
        )
    )
    end_sub = math.log10(end_share)
    end_model = math.log10(max(ends - discount, 0) / n + spare * end_share) if n else end_sub
    end_base = math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
    return (
        whole.unionByName(rest)
        .groupBy("_row")
        .agg(
            F.max("_id").alias(id_col), F.max("_held").alias("held_out"), (F.sum("_tokens") + 1).alias("n_tokens"),
            (F.sum("_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (F.sum("_base") + end_base).alias("base_score"), (F.sum("_model") + end_model).alias("score"),
            (F.sum("_sub") + end_sub).alias("lattice_score"),
        )
        .drop("_row")
    )
