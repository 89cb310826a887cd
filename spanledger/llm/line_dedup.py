"""Line removal by site-relative frequency, in DataFrame operations only.

For every host, the pages that contain a line are divided by all pages of the host; lines above the ratio are boilerplate and go from every page of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import cut_lineage, fresh_names

RATIO = 0.3
#: Pages of a host that has a line on two pages at least can lose it, however small the host; a caller may ask for more.
MIN_PAGES = 1
#: Boilerplate lines of all hosts together that may be broadcast (about 5 MB); more are joined by host.
BROADCAST_LINES = 100_000
# Fixed value: the host of a URL.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def url_host(url: str = "url") -> Column:
    """Host of a URL in lower case; null for null, '' without one."""
    return F.lower(F.regexp_extract(F.col(url), HOST, 1))


def line_key(line: Column) -> Column:
    """128 bits of a line, without outer blanks; null where nothing is left."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.md5(bare))


def boilerplate(pages: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """host and its boilerplate lines as sorted keys. A page counts a line once, and a line of a single page is none, whatever the ratio.
    At most (lines per page) / ratio keys per host pass. Without ``copies``, pages of a host with equal text are one page.

    The hot host and the hot line are summed where they lie before a shuffle; only hashes travel."""
    rows = pages.select(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    keys = F.array_distinct(F.transform(F.split("body", "\n"), line_key))
    if copies:
        one, keyed = rows.select("host"), rows.select("host", keys.alias("keys"))
    else:
        # Copies meet by the hash of their text; of each text one array of hashes travels.
        hashed = rows.select("host", F.unhex(F.md5("body")).alias("copy"), "body")
        one = hashed.select("host", "copy").distinct().select("host")
        keyed = hashed.select("host", "copy", keys.alias("keys")).groupBy("host", "copy").agg(F.any_value("keys").alias("keys")).select("host", "keys")
    totals = one.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    lines = keyed.select("host", F.explode("keys").alias("line")).where("line is not null")
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n"))
    # A line over the ratio is on min_pages * ratio pages at least.
    often = counted.where((F.col("n") > 1) & (F.col("n") > ratio * min_pages)).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """All columns of ``pages`` with the text less its host's boilerplate lines, and ``n_lines``, ``n_removed``.

    Null text stays null with no lines; a page without boilerplate keeps its text as it is; a null host is the host ''. Rows stay one for one, also
    repeated ones. Without ``copies``, a large group of copies is not its host's boilerplate. Columns called n_lines or n_removed are replaced."""
    found = cut_lineage(boilerplate(pages, host, text, ratio, min_pages, copies))
    small = (found.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_LINES
    own, gone, left = fresh_names(pages, "host", "lines", "left")
    marks = found.select(F.col("host").alias(own), F.col("lines").alias(gone))
    out = pages.drop("n_lines", "n_removed").withColumn(own, F.coalesce(host, F.lit("")))
    out = out.join(F.broadcast(marks) if small else marks, own, "left")
    lines = F.split(F.col(text).cast("string"), "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(gone), line_key(x)), F.lit(False)))
    out = out.withColumn(left, F.when(F.col(gone).isNotNull(), kept).otherwise(lines))
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.col("n_lines") - F.size(left), F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.col("n_removed") > 0, F.array_join(left, "\n")).otherwise(F.col(text))).drop(own, gone, left)
