"""URL filters: a blocked Bloom filter passes possible hits on to an exact hash join.

A list holds canonical entries, host plus path prefix, each with a verdict and a rank. An entry fits its host and all
subdomains, if the path starts with the entry's. The candidates of a URL are its host suffixes, each with those prefixes
of its path that have the length of some listed path. Every candidate is looked up in a blocked Bloom filter: one hash
picks a 64-bit block, six more bits of it must all be set. Only candidates that pass are posted, and an inner hash join
with the list on the whole entry removes the false positives. Of the entries that fit, the highest rank and then the
longest wins.

The filter has a bounded number of blocks, 512 KB, whatever the list holds; it travels as one scalar value. A longer list
only lets more false positives through to the join, which is exact. The join is left to the planner, which broadcasts the
list if it is small and splits hot keys if not; URLs are pre-aggregated, so copies of a page cost one lookup.

Defined results: a null URL or one without `://` has an empty host and path, fits nothing and is allowed; a host may be
empty. Repeated pages each get their row. An empty table gives an empty result, and an empty list allows everything.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom

def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All entries that could fit: host suffixes at label borders, each with the path's prefixes of listed lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.substring(path, F.lit(1), n)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, id_col: str, url_col: str, listed: DataFrame) -> DataFrame:
    """(id, host, path, entry, verdict, rank) of every row of pages.

    listed: (host, path, verdict, rank), each host and path once; paths start with a slash. Entry and rank are null and
    the verdict is `allow` where nothing fits."""
    listed = listed.select(
        F.concat("host", "path").alias("entry"), F.char_length("host").alias("host_chars"), "verdict", "rank", F.char_length("path").alias("chars")
    )
    # the distinct lengths of listed paths: as many as the longest path has characters, at most
    lengths = sorted(r[0] for r in listed.select("chars").distinct().collect())
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.groupBy("id", "host", "path").agg(F.count("*").alias("copies"))
    if not lengths:
        best = rows.select("*", F.lit(None).cast("string").alias("entry"), F.lit("allow").alias("verdict"), F.lit(None).cast("int").alias("rank"))
    else:
        many = listed.count()
        words = bloom.build(listed.select(F.xxhash64("entry").alias("h")), "h", many)

        asked = rows.select("id", "host", "path", F.explode(candidates(F.col("host"), F.col("path"), lengths)).alias("entry"))
        possible = asked.where((F.col("host") != "") & bloom.passes(words, F.xxhash64("entry"), many))
        # the join is on whole entries; the host part must be the listed one too, not a longer host with a shorter path
        hits = possible.join(listed, "entry").where(F.col("host").endswith(F.substring(F.col("entry"), F.lit(1), F.col("host_chars"))))
        won = F.max(F.struct("rank", F.char_length("entry").alias("chars"), "host_chars", "entry", "verdict"))
        hits = hits.groupBy("id", "host", "path").agg(won.alias("won")).alias("h")
        same = F.col("r.id").eqNullSafe(F.col("h.id")) & (F.col("r.host") == F.col("h.host")) & (F.col("r.path") == F.col("h.path"))
        best = rows.alias("r").join(hits, same, "left").select(
            "r.id", "r.host", "r.path", "copies", F.col("won.entry").alias("entry"), F.coalesce("won.verdict", F.lit("allow")).alias("verdict"), F.col("won.rank").alias("rank")
        )
    return best.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "col")
