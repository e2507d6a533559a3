"""Web archives (WARC 1.1): write pages as records, make every record a gzip member of its own, index, read back.

Method: a writer without record boundaries gives one gzip stream per file (here Spark's text writer, whose line
separator is the end of a record). The normaliser inflates such a stream once from end to end, cuts the records at
their ``Content-Length`` and deflates each into its own member; a sidecar index holds file, offset and length of every
member, so that one record can be read without the rest.

Scale: a file is one task, and files are bounded by ``records_per_file``. A task holds the compressed file (Spark's
``binaryFile`` row, under 2 GB) and one record; streams are inflated in steps of 1 MiB. All files go through Spark's
readers and writers, so they may lie in any store, and a lost executor repeats its files. Equal payloads are found on
hashes (SHA-1, xxHash and length); of the payloads in groups only the kept ones are shuffled.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.llm.common import bounded_batches, key_bitmap, split_by_bitmap, stored
from sparkclean.session import scratch_dir

LEAST_BYTES, RECORDS_PER_FILE = 1000, 5000
STEP = 1 << 20

# --- fixed values of the format ------------------------------------------------------------
CRLF = "\r\n"
END = "\r\n\r\n"
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
# ---------------------------------------------------------------------------------------------

# ---------------------------------------------------------------- writing


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _head(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF)), F.lit("")) for k, v in fields])


def marked(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str | None = "url", body_col: str = "html") -> DataFrame:
    """``_id``, ``_url``, ``_body`` (null for a revisit), ``_bytes``, ``_digest``, ``_refers`` of every page.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest id keeps its payload, the
    others refer to it. Rows that share that largest id all keep theirs; a null id is smaller than any other, and
    pages of a group without any id keep theirs.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    own = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), body.alias("_body"))
    own = own.withColumn("_bytes", F.octet_length("_body").cast("bigint")).withColumn("_digest", F.sha1("_body"))
    key = F.concat_ws("-", F.when(F.col("_bytes") < least_bytes, "small"), "_digest", F.hex(F.xxhash64("_body")))
    own = own.withColumn("_key", key)
    narrow = stored(own.drop("_body"), "warc-keys")
    groups = narrow.filter(F.col("_bytes") >= least_bytes).groupBy("_key").agg(F.max("_id").alias("_kept"), F.count("*").alias("_n"))
    groups = stored(groups.filter("_n > 1 and _kept is not null").select("_key", "_kept"), "warc-groups")
    bitmap = stored(key_bitmap(groups, "_key"), "warc-bitmap")

    joined = split_by_bitmap(narrow, "_key", bitmap)[0].join(groups, "_key", "left")
    joined = stored(joined, "warc-joined")
    revisits = joined.filter("_kept is not null and not (_id <=> _kept)")
    # kept rows of groups, and rows that only share a slot with a group: few, so is what the join with payloads moves
    pair = F.xxhash64("_key", "_id").alias("_pair")
    whole = joined.filter("_kept is null or _id <=> _kept").select("_key", F.col("_id").alias("_own"), pair).distinct()
    near, alone = split_by_bitmap(own, "_key", bitmap)
    maybe, _ = split_by_bitmap(near.withColumn("_pair", pair), "_pair", stored(key_bitmap(whole, "_pair"), "warc-whole"))
    kept = maybe.join(whole.drop("_pair"), (maybe["_key"] == whole["_key"]) & maybe["_id"].eqNullSafe(whole["_own"]), "left_semi")
    columns = ["_id", "_url", "_body", "_bytes", "_digest"]
    none = F.lit(None).cast(own.schema["_id"].dataType).alias("_refers")
    thin = revisits.select("_id", "_url", F.lit(None).cast("string").alias("_body"), "_bytes", "_digest", F.col("_kept").alias("_refers"))
    return alone.select(*columns, none).unionByName(kept.select(*columns, none)).unionByName(thin)


def record_text(kept: DataFrame, date: str) -> DataFrame:
    """Column ``value``: one record without the blank lines that end it."""
    address = F.regexp_replace(F.coalesce(F.col("_url"), F.concat(F.lit("urn:page:"), F.col("_id").cast("string"))), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("_bytes").cast("string"), F.lit(END), F.coalesce("_body", F.lit("")),
    )
    again = F.col("_refers").isNotNull()
    head = _head(
        ("WARC-Type", F.when(again, "revisit").otherwise("response")),
        ("WARC-Record-ID", _uuid(F.col("_id").cast("string"), address, F.col("_digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", address),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        ("WARC-Profile", F.when(again, SAME_PAYLOAD)),
        ("Page-Id", F.col("_id")),
        ("Page-Payload-Length", F.col("_bytes")),
        ("Page-Refers-To", F.col("_refers")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("_http")),
    )
    return kept.withColumn("_http", http).select(F.concat(F.lit(VERSION + CRLF), head, F.lit(CRLF), F.col("_http")).alias("value"))


def write_streams(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE, **options) -> None:
    """Archives of one gzip stream each; ``options`` as in :func:`marked`. No page, no record."""
    writer = record_text(marked(pages, **options), date).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


# ---------------------------------------------------------------- streams and members


def inflated(data: bytes):
    """The plain bytes of all gzip members of ``data``, in steps of at most ``STEP`` bytes."""
    at, size = 0, len(data)
    while at < size:
        stream = zlib.decompressobj(31)
        while not stream.eof:
            feed = stream.unconsumed_tail
            if not feed:
                feed, at = data[at : at + STEP], at + STEP
                if not feed:
                    raise ValueError("gzip stream ends early")
            if out := stream.decompress(feed, STEP):
                yield out
        at = min(at, size) - len(stream.unused_data)


def records(steps):
    """(header fields in lower case, bytes of the whole record, start of its block) from plain bytes in steps."""
    have = bytearray()
    steps = iter(steps)

    def more(what: str) -> None:
        step = next(steps, None)
        if step is None:
            raise ValueError(f"archive ends inside {what}")
        have.extend(step)

    while True:
        while len(have) < 5:
            step = next(steps, None)
            if step is None:
                if have.strip():
                    raise ValueError("archive ends inside a record")
                return
            have.extend(step)
        if have[:5] != b"WARC/":
            raise ValueError("no record where one should start")
        seen = 0
        while (cut := have.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(have)
            more("a header")
        lines = bytes(have[:cut]).decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = cut + 4
        end = block + int(fields["content-length"]) + 4
        while len(have) < end:
            more("a block")
        if have[end - 4 : end] != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        yield fields, bytes(have[:end]), block
        del have[:end]


def member(record: bytes, level: int = 6) -> bytes:
    """The record as one gzip member."""
    stream = zlib.compressobj(level, zlib.DEFLATED, 31)
    return stream.compress(record) + stream.flush()


def members(data: bytes):
    """(offset, length, plain bytes) of every gzip member that is not empty."""
    at, size = 0, len(data)
    while at < size:
        stream, parts, fed = zlib.decompressobj(31), [], at
        while not stream.eof:
            feed, fed = data[fed : fed + STEP], fed + STEP
            if not feed:
                raise ValueError("gzip member ends early")
            parts.append(stream.decompress(feed))
        end = min(fed, size) - len(stream.unused_data)
        if plain := b"".join(parts):
            yield at, end - at, plain
        at = end


def _files(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark, rows=16)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Write the archives of ``source``, one stream or many members each, as archives of one member per record.

    The text writer ends a row with one byte of its own; it is told to end with the byte 0, the last byte of a gzip
    member whose record is below 16 MiB. A longer record gets an empty member after it, which also ends in 0.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                out, size = [], 0
                for _, record, _ in records(inflated(data.as_py())):
                    one = member(record)
                    one = one if one[-1] == 0 else one + EMPTY_MEMBER
                    out.append(one[:-1])
                    size += len(one)
                    if size > STEP:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    found = _files(spark, source).mapInArrow(run, "value binary")
    found.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(target)


# ---------------------------------------------------------------- index and reading

INDEX = (
    "archive string, offset bigint, length bigint, record_id string, record_type string, target_uri string, page_id string, "
    "refers_to string, payload_bytes bigint, payload_digest string, stored_digest string"
)


def payload(fields: dict, record: bytes, block: int) -> bytes:
    """The body of the HTTP message in the record's block, or the block itself if it holds no message."""
    if not fields.get("content-type", "").startswith("application/http"):
        return record[block:-4]
    cut = record.find(b"\r\n\r\n", block)
    return record[cut + 4 : -4] if cut >= 0 else b""


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of normalised archives: where its member lies, and what its header and payload are.

    ``payload_bytes`` and ``payload_digest`` come from the payload itself; a revisit has none, so its header tells.
    ``stored_digest`` is what the header says. A damaged archive stops the job.
    """

    def run(batches):
        names = [part.split()[0] for part in INDEX.split(", ")]
        kinds = [pa.int64() if part.endswith("bigint") else pa.string() for part in INDEX.split(", ")]
        for batch in batches:
            for where, data in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for offset, length, plain in members(data.as_py()):
                    ((fields, record, block),) = records([plain])
                    kind = fields["warc-type"]
                    told = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "revisit":
                        size, digest = fields.get("page-payload-length"), told
                    else:
                        body = payload(fields, record, block)
                        size, digest = len(body), hashlib.sha1(body).hexdigest()
                    rows.append((
                        where.as_py(), offset, length, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"),
                        fields.get("page-id"), fields.get("page-refers-to"), None if size is None else int(size), digest, told,
                    ))
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return _files(spark, path).mapInArrow(run, INDEX)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``archive``, ``offset`` and the plain bytes ``record`` of the index rows ``wanted``: only their members are inflated.

    Wanted places travel as one list per archive, which ``records_per_file`` bounds.
    """
    places = wanted.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("_places"))
    files = _files(spark, path).withColumnRenamed("path", "archive")
    member_at = F.expr("substring(content, cast(_p.offset + 1 as int), cast(_p.length as int))")
    cut = files.join(places, "archive").select("archive", "content", F.explode("_places").alias("_p"))
    cut = cut.select("archive", F.col("_p.offset").alias("offset"), member_at.alias("_member"))

    def run(batches):
        for batch in batches:
            plain = [zlib.decompress(m, 31) for m in batch.column("_member").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("archive"), batch.column("offset"), pa.array(plain, pa.binary())], ["archive", "offset", "record"])

    return cut.mapInArrow(run, "archive string, offset bigint, record binary")


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Write the pages, normalise, index, and return the index with the types of the id restored.

    Below ``path`` (else the shared folder) stay ``streams``, ``archives`` and ``index``. Null payloads are empty,
    repeated rows are records of their own, no page gives empty folders; columns of other names are not read.
    """
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "warc")
    write_streams(pages, f"{path}/streams", id_col=id_col, **options)
    normalise(spark, f"{path}/streams", f"{path}/archives")
    index(spark, f"{path}/archives").write.parquet(f"{path}/index")
    kind = pages.schema[id_col].dataType
    found = spark.read.schema(INDEX).parquet(f"{path}/index")
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
