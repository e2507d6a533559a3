"""Removal of lines whose template recurs across documents.

Lines are parsed by a log-template tree of fixed depth: words with a digit become a variable, then the number of words
and the leading words choose a leaf. In a leaf the most frequent line is a template; lines that agree with it in
enough places belong to it, their differing places being further variables; the most frequent line of the rest is the
next template, until no line is left. Everything is DataFrame functions.

A template counts as boilerplate when documents of enough groups have it. Copies and near copies of a document are one
group, known by the rarest line, so the lines of a copied document do not count as boilerplate (removing copies is the
work of near-duplicate detection). How much of a document recurs elsewhere does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkclean.llm.common import key_bitmap, split_by_bitmap, stored

MIN_DOCS = 5
DEPTH = 3
SIMILAR = 0.6
AT_ONCE = 64  # lines of a leaf that are tried as templates in one pass; passes go on until no line is left
END = 3  # words at either end of a line by which it is known again after an edit
_VARIABLE = r"(?<!\S)[^\s\d]*+\d\S*+"


def _masked(line: Column) -> Column:
    return F.regexp_replace(F.btrim(line), _VARIABLE, "<*>")


def _parsed(own: DataFrame, depth: int) -> DataFrame:
    """_id, _th, ``line`` (number), ``leaf``, ``hash``, ``head``, ``tail``, ``tokens`` of every line that is not blank.

    ``head`` and ``tail`` are hashes of the outer words of a line, of which an edit inside the line leaves one; a short
    line is both by itself."""
    lines = own.select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("line", "_line"))
    lines = lines.select("_id", "_th", "line", _masked(F.col("_line")).alias("_masked")).filter("_masked <> ''")
    words = lines.withColumn("tokens", F.split("_masked", r"\s+")).withColumn("hash", F.xxhash64("_masked"))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))
    short = F.size("tokens") < 2 * END
    head = F.when(short, F.col("hash")).otherwise(F.xxhash64(F.lit("head"), F.slice("tokens", 1, END)))
    tail = F.when(short, F.col("hash")).otherwise(F.xxhash64(F.lit("tail"), F.slice("tokens", -END, END)))
    return words.select("_id", "_th", "line", leaf.alias("leaf"), "hash", head.alias("head"), tail.alias("tail"), "tokens")


def _templates(near: DataFrame, open_: DataFrame, depth: int, similar: float) -> DataFrame:
    """``hash`` and ``template`` of the lines that belong to the template of another line."""
    lines = _parsed(near, depth).join(open_, "leaf", "left_semi")
    rest = stored(lines.groupBy("leaf", "hash").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")), "line-leaves")

    def agree(a: Column, b: Column) -> Column:
        same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        return same >= similar * F.size(a)

    kind = "array<struct<hash: bigint, tokens: array<string>>>"
    most = Window.partitionBy("leaf").orderBy(F.desc("n"), F.desc("hash"))
    found = []
    while True:
        top = rest.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= AT_ONCE)
        top = top.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("rank", "hash", "tokens"))).alias("_top"))
        # in the order of their frequency, a line that agrees with no template so far is the next one
        own = F.aggregate(
            "_top", F.array().cast(kind),
            lambda made, x: F.when(F.exists(made, lambda t: agree(t["tokens"], x["tokens"])), made).otherwise(
                F.concat(made, F.array(F.struct(x["hash"].alias("hash"), x["tokens"].alias("tokens"))))
            ),
        )
        top = stored(top.select("leaf", own.alias("_made")), "line-tops")
        first = F.filter("_made", lambda t: agree(t["tokens"], F.col("tokens")))
        tried = stored(rest.join(top, "leaf").withColumn("template", F.get(first, F.lit(0))["hash"]).drop("_made"), "line-tried")
        found.append(tried.filter("template is not null and hash <> template").select("hash", "template"))
        rest = tried.filter("template is null").select("leaf", "hash", "tokens", "n")
        if rest.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return stored(out, "line-templates")


def _groups(lines: DataFrame) -> DataFrame:
    """_id, _th and ``group`` of documents, given their lines: the rarest line, known by the more common of its ends.

    Copies have the same rarest line, and so have near copies: an edited line keeps an end that the others have too."""
    ends = lines.select(F.explode(F.array_distinct(F.array("head", "tail"))).alias("end"))
    many = stored(ends.groupBy("end").agg(F.count("*").alias("n")).filter("n > 1"), "line-ends")
    own = lines.select("_id", "_th", "head", "tail")
    for end in ("head", "tail"):
        own = own.join(many.select(F.col("end").alias(end), F.col("n").alias(f"_{end}")), end, "left")
    known = F.greatest(*[F.struct(F.coalesce(f"_{e}", F.lit(1).cast("long")).alias("n"), F.col(e).alias("end")) for e in ("head", "tail")])
    return own.groupBy("_id", "_th").agg(F.min(known)["end"].alias("group"))


def boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH,
    similar: float = SIMILAR,
) -> DataFrame:
    """_id, _th (hash of the text) and ``dropped`` (sorted line numbers from 0) of the documents that lose lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    lines = stored(_parsed(own, depth).drop("tokens"), "lines")
    # leaves where lines of different documents differ; fewer than min_docs lines make no boilerplate
    open_ = lines.groupBy("leaf").agg(
        F.min("hash").alias("a"), F.max("hash").alias("b"), F.min("_th").alias("c"), F.max("_th").alias("d"), F.count("*").alias("n")
    )
    open_ = stored(open_.filter("a <> b and c <> d").filter(F.col("n") >= min_docs).select("leaf"), "line-open")
    holders = lines.select("leaf", "_th").join(open_, "leaf", "left_semi").select("_th")
    near, _ = split_by_bitmap(own, "_th", key_bitmap(holders, "_th"))
    belongs = _templates(near, open_, depth, similar)
    lines = stored(
        lines.join(belongs, "hash", "left").select("_id", "_th", "line", "head", "tail", F.coalesce("template", "hash").alias("template")),
        "lines",
    )

    def often(rows: DataFrame) -> DataFrame:
        return rows.distinct().groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("template")

    common = stored(often(lines.select("template", "_id", "_th")), "line-common")
    again = stored(lines.join(common, "template", "left_semi").select("_id", "_th", "line", "template"), "line-again")
    holding = again.select("_id", "_th").distinct()
    groups = _groups(stored(lines.join(holding, ["_id", "_th"], "left_semi"), "line-holding"))
    plate = stored(often(again.join(groups, ["_id", "_th"]).select("template", "group")), "line-boilerplate")
    gone = again.join(plate, "template", "left_semi")
    return stored(gone.groupBy("_id", "_th").agg(F.array_sort(F.collect_set("line")).alias("dropped")), "line-dropped")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs``, the text without boilerplate lines, and ``dropped_lines`` (numbers from 0, or empty).

    No row is removed; a document of boilerplate alone is left with the empty text. Null texts stay null. Blank lines
    are kept and count for nothing. Equal rows are one document, rows of one id with different texts are two; a null id
    is kept and its lines are neither counted out nor removed.
    """
    cuts = boilerplate(docs, id_col, text_col, **options)
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*columns)
    key, text = columns[docs.columns.index(id_col)], columns[docs.columns.index(text_col)]
    own = own.withColumn("_th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    near, far = split_by_bitmap(own, "_th", key_bitmap(cuts, "_th"))
    none = F.array().cast("array<int>")
    cuts = cuts.withColumnRenamed("_id", "_cut").withColumnRenamed("_th", "_cth")
    near = near.join(cuts, (F.col(key) == F.col("_cut")) & (F.col("_th") == F.col("_cth")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    near = near.withColumn(text, F.when(F.col("dropped").isNull(), F.col(text)).otherwise(kept))
    both = near.select(*columns, F.coalesce("dropped", none).alias("dropped_lines")).unionByName(far.select(*columns, none.alias("dropped_lines")))
    return both.toDF(*docs.columns, "dropped_lines")
