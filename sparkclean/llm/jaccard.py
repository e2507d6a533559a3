"""Exact Jaccard join of documents by their word n-grams.

The document by n-gram incidence matrix is multiplied with its transpose block by block, and only where a pair can
still reach the threshold. N-grams are ordered by the rarest word pair in them (a sketch of the pairs of all documents); a
document brings the first |x| - ceil(t|x|) + k of them. Equal sets meet once.

1. Each document is tried against the most central document of its n-grams: its leader.
2. A leader and its documents are a family. Those linked with the leader are one class; the others are multiplied
   with all members in blocks of bounded size, inside tasks, and only spanning links leave a block.
3. Between documents of different classes and families the overlaps of the leading n-grams are counted; a pair whose
   count, with all that can still follow, stays below the overlap that the sizes ask for is discarded, the others get
   their exact overlap from the whole sets.

No link between different classes is lost, and no group of near copies gives all its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import (
    SMALL_BATCH,
    ascii_lower,
    batches_of,
    bounded_batches,
    giving_back,
    gram_hashes,
    key_bitmap,
    lists_of,
    mix,
    split_by_bitmap,
    stored,
    word_hashes,
)

SKETCH_BITS = 17
COMMON = 3  # leading n-grams beyond the fewest that must meet: more of them discard more pairs
BLOCK = 256  # documents of a family in a block of the product
SLICE = 4096  # n-grams of a block that are multiplied at once
_SHIFT = np.uint64(64 - SKETCH_BITS)


def _part(n: int) -> int:
    """Words of the parts of an n-gram whose counts are sketched; the rarest part bounds the n-gram."""
    return min(n, 2)


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return (gram_hashes(values, _part(n)) >> _SHIFT).astype(np.int64)


def _sets(values: np.ndarray, offsets: np.ndarray, n: int, weight: np.ndarray | None = None):
    """The distinct n-gram hashes of each list, sorted, and the frequency of each (the least of its parts, ``weight``
    by bucket); of a shorter list, one hash of the whole."""
    grams = gram_hashes(values, n)
    if weight is not None:
        part = weight[_bucket(values, n)]
        often = part[: len(grams)]
        for k in range(1, n - _part(n) + 1):
            often = np.minimum(often, part[k : k + len(grams)])
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        if end - start >= n:
            if weight is None:
                yield np.unique(grams[start : end - n + 1]), None
            else:
                own, at = np.unique(grams[start : end - n + 1], return_index=True)
                yield own, often[start : end - n + 1][at]
        elif end > start:
            yield mix(gram_hashes(values[start:end], int(end - start)) + np.uint64(end - start)), np.zeros(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _name(own: np.ndarray) -> bytes:
    """128 bits that do not depend on the order."""
    return np.array([mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)]).tobytes()


def _overview(own: DataFrame, n: int) -> DataFrame:
    """_id, ``size``, ``set`` (hash of the set) per row, and ``bucket``, ``size``: one sketch of word pair counts per task."""
    schema = pa.schema([("_id", pa.int64()), ("size", pa.int64()), ("set", pa.binary()), ("bucket", pa.int32())])

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            values, offsets = lists_of(batch.column("_words"))
            sketch += np.bincount(_bucket(values, n), minlength=1 << SKETCH_BITS)
            size, name = [], []
            for s, _ in _sets(values, offsets, n):
                size.append(len(s))
                name.append(_name(s))
            yield from batches_of({"_id": batch.column("_id").to_numpy(), "size": size, "set": name, "bucket": [None] * len(size)}, schema)
        used = np.flatnonzero(sketch)
        yield from batches_of({"_id": [None] * len(used), "size": sketch[used], "set": [None] * len(used), "bucket": used}, schema)

    return own.mapInArrow(giving_back(run), "_id bigint, size bigint, set binary, bucket int")


def _lead(size, percent: int):
    return min(size, size - -(-percent * size // 100) + COMMON)


def _postings(own: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """gram, _id, ``size``, ``place`` for the leading n-grams of every row; a set once per task."""
    schema = pa.schema([("gram", pa.int64()), ("_id", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])

    def run(batches):
        seen = set()
        for batch in batches:
            ids = batch.column("_id").to_numpy()
            grams, rows, places, sizes = [], [], [], []
            for r, (s, often) in enumerate(_sets(*lists_of(batch.column("_words")), n, sketch)):
                if not len(s) or (name := _name(s)) in seen:
                    continue
                seen.add(name)
                lead = _lead(len(s), percent)
                grams.append(s[np.argsort(often, kind="stable")[:lead]])
                rows.append(np.full(lead, r))
                places.append(np.arange(lead))
                sizes.append(np.full(lead, len(s)))
            if grams:
                columns = {"gram": np.concatenate(grams).view(np.int64), "_id": ids[np.concatenate(rows)], "size": np.concatenate(sizes), "place": np.concatenate(places)}
                yield from batches_of(columns, schema)

    return own.mapInArrow(giving_back(run), "gram bigint, _id bigint, size int, place int")


def _whole_sets(own: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [s.view(np.int64) for s, _ in _sets(*lists_of(batch.column("_words")), n)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.list_(pa.int64()))], ["_id", "grams"])

    return own.mapInArrow(giving_back(run), "_id bigint, grams array<bigint>")


def _linked(pairs: DataFrame, incidence, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold; ``incidence`` gives the sets of some ids."""
    sets = incidence(stored(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "jaccard-needed"))
    a = sets.select(F.col("_id").alias("a"), F.col("grams").alias("_ga"))
    b = sets.select(F.col("_id").alias("b"), F.col("grams").alias("_gb"))
    common = F.size(F.array_intersect("_ga", "_gb"))
    either = F.size("_ga") + F.size("_gb") - common
    return pairs.select("a", "b").join(a, "a").join(b, "b").filter(100 * common >= percent * either).select("a", "b").distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Left by right overlap counts: the product of two incidence blocks, over slices of the common n-grams."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(common), SLICE):
        some = common[start : start + SLICE]
        blocks = []
        for sets in (left, right):
            block = np.zeros((len(sets), len(some)), np.float32)
            for r, s in enumerate(sets):
                at = np.searchsorted(some, s)
                block[r, at[some[np.minimum(at, len(some) - 1)] == s]] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def _family_links(families: DataFrame, incidence, percent: int) -> DataFrame:
    """Links (a, b) inside families (``rep``, ``family``, ``bound``: linked with the leader).

    Bound members are one class already. The others are multiplied with all members in blocks of about ``BLOCK``
    documents each; of a block product only a spanning set of links leaves the task.
    """
    size = families.groupBy("family", "bound").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    size = size.groupBy("family").agg(
        F.coalesce(F.max(F.when(~F.col("bound"), F.col("n"))), F.lit(0)).alias("free"), F.coalesce(F.max(F.when(F.col("bound"), F.col("n"))), F.lit(0)).alias("tied")
    )
    size = stored(size.filter("free > 0"), "jaccard-families")
    member = families.join(size, "family").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.when(F.col("bound"), F.col("tied")).otherwise(F.col("free"))).cast("int")
    )
    member = stored(member, "jaccard-family-members")

    def pairs(n, make):
        return F.transform(F.sequence(F.lit(1), n), lambda i: make((i - 1).cast("int")))

    def key(kind, p, q, right):
        return F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), right.alias("right"))

    none = F.array().cast("array<struct<kind:string,p:int,q:int,right:boolean>>")
    b = F.col("block")
    among = pairs(F.col("free"), lambda i: key("free", F.least(i, b), F.greatest(i, b), b > i))
    across = F.when(F.col("tied") > 0, pairs(F.col("tied"), lambda j: key("tied", b, j, F.lit(False)))).otherwise(none)
    facing = pairs(F.col("free"), lambda i: key("tied", i, b, F.lit(True)))
    keys = F.when(F.col("bound"), facing).otherwise(F.concat(among, across))
    sets = incidence(stored(member.select(F.col("rep").alias("_id")).distinct(), "jaccard-needed"))
    dealt = member.select("family", "rep", F.inline(keys)).join(sets, F.col("rep") == F.col("_id")).drop("_id")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sets = pdf["rep"].to_numpy(), list(pdf["grams"])
        one_block = pdf["kind"].iloc[0] == "free" and pdf["p"].iloc[0] == pdf["q"].iloc[0]
        left = np.flatnonzero(~pdf["right"].to_numpy() | one_block)
        right = left if one_block else np.flatnonzero(pdf["right"].to_numpy())
        found = {"a": [], "b": []}
        if len(left) and len(right):
            over = _overlaps([sets[i] for i in left], [sets[i] for i in right])
            n = np.array([len(s) for s in sets], np.float32)
            hit = 100 * over >= percent * (n[left][:, None] + n[right][None, :] - over)
            top = {i: i for i in range(len(ids))}

            def find(i):
                while top[i] != i:
                    top[i] = top[top[i]]
                    i = top[i]
                return i

            for x, y in zip(*np.nonzero(hit), strict=True):
                i, j = find(left[x]), find(right[y])
                if i != j:
                    top[i] = j
                    found["a"].append(ids[left[x]])
                    found["b"].append(ids[right[y]])
        return pd.DataFrame(found, dtype="int64")

    links = dealt.groupBy("family", "kind", "p", "q").applyInPandas(product, "a bigint, b bigint")
    return links.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node of the undirected edges (a, b).

    Smallest neighbouring label and pointer jumping, one written table a round: a star settles in two rounds, a chain
    in about the logarithm of its length.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = stored(labels, "graph-labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("_other"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("_other").alias("_near"))
        near = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("_near", "component")).alias("_new"))
        near = stored(near, "graph-near")
        up = near.select(F.col("node").alias("_new"), F.col("_new").alias("_top"))
        jumped = near.join(up, "_new", "left").select("node", "component", F.coalesce("_top", "_new").alias("_final"))
        jumped = stored(jumped, "graph-labels")
        labels = jumped.select("node", F.col("_final").alias("component"))
        if jumped.filter("component <> _final").isEmpty():
            return labels


def classes(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", ascii_fold: bool = True
) -> DataFrame:
    """id, ``n_shingles``, ``component_id`` of every row with an id.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of ``n`` consecutive words, words
    being runs of other than ASCII white space, lower-cased A-Z; with fewer words the whole sequence is the one
    element. ``component_id`` is the smallest id reachable by links. Without words (null, empty, blank text) the set is
    empty and the row links with nothing. Ids are integers, one for each text: equal rows get equal results, of rows that
    share an id with different texts links may be missed; rows without id are left out.
    """
    bounded_batches(docs.sparkSession, size=SMALL_BATCH)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), (ascii_lower(text) if ascii_fold else text).alias("_text")).filter("_id is not null")

    def hashed(df):
        return df.select("_id", word_hashes(F.col("_text")).alias("_words"))

    seen = stored(_overview(hashed(texts), n), "jaccard-overview")
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in seen.filter("bucket is not null").groupBy("bucket").agg(F.sum("size").alias("n")).collect():  # at most 2^17
        sketch[r["bucket"]] = r["n"]
    rows = seen.filter("bucket is null").select("_id", "size", "set")
    first = stored(rows.filter("size > 0").groupBy("set").agg(F.min("_id").alias("rep")), "jaccard-sets")
    member = stored(rows.filter("size > 0").join(first, "set").select("_id", "size", "rep"), "jaccard-members")

    def incidence(needed):
        near, _ = split_by_bitmap(texts, "_id", key_bitmap(needed, "_id"))
        wanted = near.join(needed, "_id", "left_semi").dropDuplicates(["_id", "_text"])
        return stored(_whole_sets(hashed(wanted), n), "jaccard-incidence")

    post = stored(_postings(hashed(texts), n, percent, sketch), "jaccard-postings")
    shared = stored(post.groupBy("gram").agg(F.min("_id").alias("x"), F.max("_id").alias("y")).filter("x <> y").select("gram"), "jaccard-shared")
    post = stored(post.join(shared, "gram", "left_semi"), "jaccard-blocks")
    names = stored(member.select("_id", "rep").distinct(), "jaccard-names")
    post = post.join(names, "_id").groupBy("gram", "rep").agg(F.max("size").alias("size"), F.min("place").alias("place"))
    post = stored(post, "jaccard-blocks")

    # the document of each block that shares most of its leading n-grams, and for each document its best leader
    def leading(size):
        return F.least(size, size - F.ceil(size * percent / 100) + COMMON)

    central = post.groupBy("rep").agg((F.count("*") / F.max(leading(F.col("size")))).alias("central"))
    central = stored(post.join(stored(central, "jaccard-central"), "rep"), "jaccard-blocks")
    lead = stored(central.groupBy("gram").agg(F.max(F.struct("central", "size", "rep")).alias("_top")), "jaccard-leaders")
    stars = (
        central.join(lead, "gram")
        .select(F.col("rep").alias("a"), F.col("_top.rep").alias("b"), "size", F.col("_top.size").alias("_s"), F.col("_top.central").alias("_c"))
        .filter("a <> b")
        .filter((100 * F.least("size", "_s") >= percent * F.greatest("size", "_s")))
        .groupBy("a", "b")
        .agg(F.count("*").alias("_n"), F.max("_c").alias("_c"), F.max("_s").alias("_s"))
        .filter(f"_n >= {COMMON} or _s < 20")  # fewer of a large set are chance; the product below tries them
        .groupBy("a")
        .agg(F.max(F.struct("_n", "_c", "b")).alias("_best"))
        .select("a", F.col("_best.b").alias("b"))
    )
    stars = stored(stars, "jaccard-stars")
    edges = stored(_linked(stars, incidence, percent), "jaccard-edges")

    # a family: a leader, the documents whose best leader it is, and those of which one of these is the best leader;
    # all pairs within are settled block by block
    tied = edges.select("a", "b", F.lit(True).alias("_tied"))
    first = stored(stars.join(tied, ["a", "b"], "left").withColumn("_tied", F.coalesce("_tied", F.lit(False))), "jaccard-first")
    second = first.select(F.col("a").alias("b"), F.col("b").alias("_up"), F.col("_tied").alias("_up_tied"))
    up = F.when(F.col("_up") == F.col("a"), F.least("a", "b")).otherwise(F.coalesce("_up", "b"))
    family = first.join(second, "b", "left").withColumn("family", up)
    bound = F.col("_tied") & ((F.col("family") == F.col("b")) | (F.col("family") == F.col("a")) | F.coalesce("_up_tied", F.lit(False)))
    family = family.select(F.col("a").alias("rep"), "family", bound.alias("bound"))
    heads = family.select(F.col("family").alias("rep"), "family", F.lit(True).alias("bound")).distinct()
    members = family.unionByName(heads).groupBy("rep", "family").agg(F.max("bound").alias("bound"))
    inner = _family_links(stored(members, "jaccard-family"), incidence, percent)
    edges = stored(edges.unionByName(inner), "jaccard-edges")
    label = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("class"))

    # the product between documents of different classes and families
    own = family.select("rep", "family")
    post = post.join(label, "rep", "left").join(own, "rep", "left")
    post = post.withColumn("class", F.coalesce("class", "rep")).withColumn("family", F.coalesce("family", "rep"))
    post = stored(post, "jaccard-classed")
    open_ = stored(post.groupBy("gram").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("gram"), "jaccard-open")
    post = stored(post.join(open_, "gram", "left_semi"), "jaccard-blocks")
    names = ("class", "family", "size", "place")
    x = post.select("gram", F.col("rep").alias("a"), *(F.col(c).alias(f"_x{c}") for c in names))
    y = post.select("gram", F.col("rep").alias("b"), *(F.col(c).alias(f"_y{c}") for c in names))
    xs, ys = F.col("_xsize"), F.col("_ysize")
    apart = (F.col("_xclass") != F.col("_yclass")) & (F.col("_xfamily") != F.col("_yfamily"))
    ordered = (xs < ys) | ((xs == ys) & (F.col("a") < F.col("b")))
    # all sets have one order, so n-grams before a common one meet before it and those after it meet after it
    need = F.ceil((xs + ys) * percent / (100 + percent))
    px, py = F.col("_xplace"), F.col("_yplace")
    reach = F.least(px, py) + F.least(xs - px, ys - py) >= need
    pairs = x.join(y, "gram").filter(apart & ordered & (100 * xs >= percent * ys) & reach)
    # beyond the leading n-grams of the one whose last is rarer, at most the rest of it can be common
    rest = F.greatest(xs - leading(xs), ys - leading(ys))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("_n"), F.max(need - rest).alias("_need"))
    pairs = pairs.filter(F.col("_n") >= F.greatest(F.lit(1), F.col("_need"))).select("a", "b")
    more = _linked(stored(pairs, "jaccard-pairs"), incidence, percent)
    edges = stored(edges.unionByName(more), "jaccard-edges")
    label = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("_component"))
    label = stored(label, "jaccard-labels")
    return (
        member.join(label, "rep", "left")
        .select("_id", "size", F.coalesce("_component", "rep").alias("component_id"))
        .unionByName(rows.filter("size = 0").select("_id", "size", F.col("_id").alias("component_id")))
        .select(F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")
    )
