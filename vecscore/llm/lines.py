"""Line deduplication by site-relative frequency, with DataFrame functions alone.

Within each host, a line's frequency is the share of the host's pages that contain it. Lines above
a ratio are boilerplate and go. Counting is partial before its shuffle and over hashes of lines;
what comes back per host is a short list (at most lines per page / ratio of them, on average): by
a broadcast if all lists measure few bytes, else under a salt so that a large host is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import join_measured

#: Boilerplate: on more than this share of the host's pages, and on at least so many of them.
RATIO, LEAST_PAGES = 0.05, 4


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """What two lines must share to count as the same: the line without surrounding blanks, hashed."""
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines.

    A line counts once per page; blank lines never count. Rows are pages, repeated ones too.
    """
    keys = F.array_distinct(F.transform(F.filter(_lines(F.coalesce(text, F.lit(""))), lambda x: F.trim(x) != ""), _key))
    counts = docs.select(host.alias("host"), F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    pages = docs.groupBy(host.alias("h")).agg(F.count(F.lit(1)).alias("pages"))  # reads no text
    often = counts.filter(F.col("n") >= least_pages)
    often = often.join(pages, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def dedup_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The rows of docs with boilerplate lines cut from the text, and columns n_lines and n_dropped.

    Rows with a null host form a host of their own. Null text stays null, a text of boilerplate
    alone becomes empty, kept lines stay as they are, in order. Repeated rows are pages of their
    own; an empty table stays empty; columns named n_lines or n_dropped are replaced, any others
    kept.
    """
    base = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")])
    host, text = F.col(f"`{host_col}`"), F.col(f"`{text_col}`")
    found = boilerplate(base, host, text, ratio, least_pages)
    found = found.select(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("-")).alias("__host"), F.col("lines").alias("__lines"))
    keyed = base.withColumn("__host", F.coalesce(F.concat(F.lit("h"), host), F.lit("-")))
    all_lines = _lines(text)
    kept = F.filter(all_lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__lines"), _key(x)))
    joined = join_measured(keyed, found, ["__host"], F.octet_length("__host") + 8 * F.size("__lines"), text).withColumn("__kept", F.when(F.col("__lines").isNull(), all_lines).otherwise(kept))
    return joined.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns],
        F.when(text.isNull(), 0).otherwise(F.size(all_lines)).cast("bigint").alias("n_lines"),
        F.when(text.isNull(), 0).otherwise(F.size(all_lines) - F.size("__kept")).cast("bigint").alias("n_dropped"),
    )


#: The same for DuckDB, over documents with its source as the host.
ORACLE = f"""
WITH line AS (
    SELECT doc_id, source, text, i, l FROM (
        SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS l FROM documents)),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counts AS (SELECT source, trim(l, ' ') AS l, count(DISTINCT doc_id) AS n FROM line WHERE trim(l, ' ') <> '' GROUP BY 1, 2),
often AS (SELECT source, l FROM counts JOIN pages USING (source) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages),
kept AS (SELECT line.*, often.l IS NOT NULL AS gone FROM line LEFT JOIN often ON often.source = line.source AND often.l = trim(line.l, ' '))
SELECT doc_id, source, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM kept GROUP BY doc_id, source
"""
