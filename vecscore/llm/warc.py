"""WARC archives: writing pages as records, and reading by a verified chain of record boundaries.

Writing uses Spark's text writer: a record is a line whose end is the blank line that closes every
record, so files are committed by Spark's own protocol to any file system.

Reading splits files at every occurrence of the version line, in byte ranges, so a large archive
is read by many tasks. A payload may hold that line too. Each task therefore only emits
candidates: a record's offset and, from its Content-Length, that of its successor. Pointer jumping
from offset 0 then doubles the reach of each round and keeps only the records on the chain; what
else looked like a record lies within a payload and is put back there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from vecscore.llm.common import join_measured, shared_dir, stage

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Records of one archive file at most.
FILE_RECORDS = 20_000


def _clean(c: Column) -> Column:
    """A header value: control characters would end the line."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", " ")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, keeper): keeper is the page whose record holds an equal payload.

    It is null for what is written as a response itself. Of equal payloads the largest page_id is
    kept; rows that repeat that id are all responses, as are null ids if no other is there.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8")))
    groups = rows.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("n > 1 and keeper is not null").select("payload_digest", "keeper")
    joined = join_measured(rows, groups, ["payload_digest"], F.lit(48), F.col("page_id"))
    same = F.col("keeper").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(~same, F.col("keeper")).alias("keeper"))


def write_warc(planned: DataFrame, path: str) -> None:
    """Write the records of plan_records() as archives under path."""
    revisit = F.col("keeper").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), _clean(F.col("url")), F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("keeper")))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string"),
        F.lit(BLANK), F.when(revisit, "").otherwise(F.col("payload")),
    )
    planned.select(record.alias("value")).write.option("lineSep", BLANK).option("maxRecordsPerFile", FILE_RECORDS).text(path)


_LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)[ \t]*(?=\r\n|$)", re.IGNORECASE)
_SEGMENT = "file string, block bigint, before bigint, size bigint, total bigint, head binary, payload_bytes bigint, payload_digest string"
_RECORD = "file string, start bigint, head binary, payload_bytes bigint, payload_digest string, pieces array<bigint>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): what lies between version lines, in order within each block."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines: one candidate each, unless its head has no length.

    before: bytes of the block's earlier segments; size: its bytes with a version line; total:
    bytes up to the successor it claims; payload_digest: if the segment is one whole record.
    """
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(_SEGMENT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, before = None, 0
        for batch in batches:
            out: list[tuple] = []
            for data, file, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place != (file, block):
                    place, before = (file, block), 0
                size = len(data) + len(MAGIC)
                total = head = n = digest = None
                cut = data.find(b"\r\n\r\n")
                if cut >= 0 and (found := _LENGTH.search(data, 0, cut)):
                    head, n = data[:cut], int(found[1])
                    total = len(MAGIC) + cut + 4 + n + 4
                if total == size and data.endswith(b"\r\n\r\n"):
                    digest = hashlib.sha1(memoryview(data)[cut + 4 : cut + 4 + n]).hexdigest()
                out.append((file, block, before, size, total, head, n, digest))
                before += size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return _lines(spark, path).mapInArrow(run, _SEGMENT)


def raw_pieces(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(file, start, data) for wanted (file, start, piece): a record's segments put together again.

    A second scan, only for records whose payload holds version lines. Offsets are counted anew
    within the scan, so it need not be split like the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, before = None, 0
        for batch in batches:
            at = []
            for data, *here in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place != here:
                    place, before = here, 0
                at.append(before)
                before += len(data) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.int64()), batch.column(0)], names=["file", "block", "before", "raw"])

    found = _lines(spark, path).mapInArrow(run, "file string, block bigint, before bigint, raw binary")
    ends = found.groupBy("file", "block").agg(F.max(F.col("before") + F.octet_length("raw") + len(MAGIC)).alias("bytes"))
    base = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.join(ends.select("file", "block", base.alias("base")), ["file", "block"]).select("file", (F.col("base") + F.col("before") - len(MAGIC)).alias("piece"), "raw")
    groups = placed.join(wanted, ["file", "piece"]).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("piece", "raw"))).alias("all"))
    data = F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, F.lit(MAGIC.encode()), x["raw"]))
    return groups.select("file", "start", data.alias("data"))


def reachable(successor: np.ndarray) -> np.ndarray:
    """Which nodes a chain from node 0 visits, by pointer jumping; successor -1 ends it."""
    n = len(successor)
    jump = np.r_[np.where(successor < 0, n, successor), n]
    seen = np.zeros(n + 1, bool)
    seen[0] = True
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        if (more == seen).all():
            return seen[:n]
        seen, jump = more, jump[jump]


def chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The records of one file; with the offsets of their segments if there are several. Raises ValueError if the chain breaks off before the end."""
    rows = rows.sort_values(["block", "before"], ignore_index=True)
    stop = rows["size"].cumsum().to_numpy()
    start = stop - rows["size"].to_numpy() - len(MAGIC)
    # Segment 0 is what precedes the first version line; that of segment i begins at start[i].
    start, size_of_file = start[1:], int(stop[-1]) - len(MAGIC)
    rows = rows.iloc[1:].reset_index(drop=True)
    if not len(rows):
        return pd.DataFrame({x.split()[0]: [] for x in _RECORD.split(", ")})
    total = rows["total"].fillna(-1).astype("int64").to_numpy()
    to = np.where(total > 0, start + total, -1)
    at = np.searchsorted(start, to)
    successor = np.where((to >= 0) & (at < len(start)) & (start[np.minimum(at, len(start) - 1)] == to), at, -1)
    kept = np.flatnonzero(reachable(successor))
    if start[0] != 0 or to[kept[-1]] != size_of_file:
        raise ValueError(f"the archive's records break off at byte {start[kept[-1]]}")
    found = rows.iloc[kept][["file", "head", "payload_bytes", "payload_digest"]].reset_index(drop=True)
    found["start"] = start[kept]
    ends = np.r_[kept[1:], len(rows)]
    found["pieces"] = [start[lo:hi].tolist() if hi - lo > 1 else [] for lo, hi in zip(kept, ends, strict=True)]
    return found[[x.split()[0] for x in _RECORD.split(", ")]]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest) of all records under path.

    Digest and length of a revisit are those of the response it refers to. Empty files give no
    rows.
    """
    staged = stage(segments(spark, path))
    records = stage(staged.groupBy("file").applyInPandas(chain, _RECORD))
    several = records.filter(F.size("pieces") > 0)
    if several.limit(1).count():
        data = raw_pieces(spark, path, several.select("file", "start", F.explode("pieces").alias("piece")))
        body = F.substring("data", F.octet_length("head") + len(MAGIC) + 5, F.col("payload_bytes").cast("int"))
        mended = several.drop("payload_digest", "pieces").join(data, ["file", "start"]).select("head", "payload_bytes", F.sha1(body).alias("payload_digest"))
        records = records.filter(F.size("pieces") == 0).select(mended.columns).unionByName(mended)
    head = F.col("head").cast("string")
    field = lambda name: F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    number = lambda name: F.regexp_extract(field(name), r"<urn:x-page:(-?\d+)>", 1)
    as_id = lambda c: F.when(c != "", c).cast("bigint")
    parsed = records.select(
        as_id(number("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), as_id(number("WARC-Refers-To")).alias("refers_to"),
        "payload_bytes", "payload_digest", F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("said"),
    )
    parsed = stage(parsed.withColumn("payload_digest", F.when((F.col("record_type") == "response") & (F.col("said") != F.col("payload_digest")), F.raise_error(F.lit("a payload's digest is not its header's")).cast("string")).otherwise(F.col("payload_digest"))))
    responses = parsed.filter("record_type = 'response'")
    revisits = parsed.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    # Lengths of those responses alone that are referred to, so that a payload with very many revisits is no hot key.
    wanted = revisits.select(F.col("refers_to").alias("page_id"), F.col("said").alias("payload_digest")).distinct()
    targets = responses.join(wanted, ["page_id", "payload_digest"], "left_semi").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = join_measured(revisits, targets, ["refers_to", "said"], F.lit(64), F.col("page_id"))
    columns = ("page_id", "url", "record_type", "refers_to", "payload_bytes")
    return responses.select(*columns, "payload_digest").unionByName(revisits.select(*columns, F.col("said").alias("payload_digest")))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write a record per row of pages, read the archives back and return a row per record.

    Null html is the empty payload; null ids and urls survive (a null url as an empty header);
    repeated rows give repeated records; an empty table gives an empty frame.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    write_warc(plan_records(pages), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same for DuckDB.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
