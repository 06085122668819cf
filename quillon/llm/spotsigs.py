"""Document fingerprints by SpotSigs, in native expressions.

A spot is an occurrence of an anchor, one of a few very common words; its signature is the anchor with the chain of the
next CHAIN content words, anchors in between skipped. A text's fingerprint is the set of its signatures' 32-bit hashes,
ascending, as hex digits, eight each; a text with words but without any spot has the hash of its whole word sequence as
its one signature, so that different texts stay apart. Anchors are lists of some languages; near_duplicates() signs texts
in which they are rare by all chains of consecutive words, but a query of fingerprints does not. Likeness of two fingerprints is the Jaccard similarity of their
sets, pruned: sets whose lengths alone keep them under a wanted likeness are not intersected.

near_duplicates() compares all texts: fingerprints are grouped first, so copies cost one; they are partitioned by set
length, such that sets of a likeness of at least t meet in the same or in neighbouring partitions; there they are joined
on the rarest of their signatures, as many as a pair of that likeness can't miss, and compared by pruned Jaccard.

with_next() gives each text its successor by id without one task for all: ids are cut at quantiles of a sample, those of
many rows by the hash of the text as well, each range is a window of its own, and the last text of a range gets the first
of the next range.

Defined results: a null text is an empty one; an empty text, or one without letters or digits, has the empty fingerprint,
which is 1 like itself and 0 like others. Ids may be of any type with an order. Ties in the id go by the text's hash, then by
the text. The last text's successor is the first, a lone text's
is itself. Rows with a null id come first. Very long texts are taken whole. An empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# fixed values: frequent function words of English, French, German, Spanish and other languages of Europe and its
# neighbours; words that are common content words of the first four are left out
ANCHORS = (
    "the of and to in is that for it as was with be by on are this from at an or which not have has had they their but "
    "le la les des et du un une dans que qui pour par est sur au pas plus avec ce il elle "
    "der die das und den von zu mit sich dem ein eine auf nicht im ist auch es als an "
    "el los las del una con por para se su al como más lo no "
    "il che di è della delle dei nel alla sono anche gli questo "
    "não uma os da mas são também ao pela pelo "
    "het een en niet zijn voor met aan ook maar wordt deze "
    "och att det som är på av inte ett till hon jag har "
    "og ikke af til være blev eller fra "
    "ja se oli että hän mutta niin kun myös joka ovat kuin sitä "
    "i w z na się nie że do jak przez był dla są od po tym który "
    "v že je si ve jsem byl ako sú som alebo "
    "és hogy nem egy az volt csak ez "
    "și în cu este să din pentru "
    "ve bir bu için ile da de çok ama gibi daha olarak olan ne "
    "и в не на что он с как это по но его к из у за от же был для о так а "
    "і що та це як від у до із є й "
    "και το η του της να με που στο στην είναι από για δεν "
    "في من على أن إلى هذا التي الذي عن كان ما لا و "
    "של את על לא הוא זה כי עם גם "
    "और के है में की से को का यह पर "
    "yang dan untuk dengan tidak ini itu dari pada adalah"
).split()
CHAIN = 2
#: Words of which one at least should start a spot.
SPARSE = 20
#: Rows of a range of with_next(), sampled ones of a range, and most ranges, whose table is held by the driver.
RANGE_ROWS = 2_000
KEYS_PER_RANGE = 8
MOST_RANGES = 100_000


def with_signatures(df: DataFrame, text: Column, out: str, chains: bool = False) -> DataFrame:
    """Adds the sorted distinct 32-bit signature hashes of a text. With `chains`, texts with fewer than one spot in SPARSE
    words are signed by their chains of CHAIN + 1 consecutive words."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    words, spots, content, whole = out + "_words", out + "_spots", out + "_content", out + "_plain"
    anchor = lambda w: w.isin(*sorted(set(ANCHORS)))
    df = df.withColumn(whole, plain).withColumn(words, F.split(F.col(whole), " "))
    places = F.filter(F.transform(words, lambda w, i: F.when(anchor(w), i).otherwise(-1)), lambda i: i >= 0)
    df = df.withColumns({spots: places, content: F.filter(words, lambda w: ~anchor(w))})
    # before the k-th anchor, at place p, there are p - k content words: its chain starts at that index
    last = F.size(content) - CHAIN
    chained = F.filter(spots, lambda p, k: p - k <= last)
    hashed = F.transform(
        chained, lambda p, k: F.xxhash64(F.get(words, p), *[F.get(content, p - k + j) for j in range(CHAIN)]).bitwiseAND(0xFFFFFFFF)
    )
    text_col = F.col(whole)
    alone = F.when(text_col != "", F.array(F.xxhash64(text_col, F.lit("whole")).bitwiseAND(0xFFFFFFFF))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(out + "_hashed", F.array_sort(F.array_distinct(hashed)))
    if chains:
        each = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - CHAIN - 1, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(CHAIN + 1)], F.lit("chain")).bitwiseAND(0xFFFFFFFF),
        )
        sparse = (F.size(words) > CHAIN) & (SPARSE * F.size(out + "_hashed") < F.size(words))
        df = df.withColumn(out + "_hashed", F.when(sparse, F.array_sort(F.array_distinct(each))).otherwise(F.col(out + "_hashed")))
    found = F.when(F.size(out + "_hashed") > 0, F.col(out + "_hashed")).otherwise(alone)
    return df.withColumn(out, found).drop(whole, words, spots, content, out + "_hashed")


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a look if their lengths keep it under `least`."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    bound = F.least(n, m) / F.greatest(n, m, F.lit(1))
    return (
        F.when((n == 0) & (m == 0), F.lit(1.0))
        .when((bound == 0) | (bound < least), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(both / (n + m - both))
        .cast("double")
    )


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, ghost, id, h, text): rows in ranges of ids, hash-partitioned by range. A ghost row at the end of each range
    repeats the first text of the next range, or of the first range at the very end."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    ranges = min(MOST_RANGES, max(4 * parts, n // RANGE_ROWS))
    share = min(1.0, KEYS_PER_RANGE * ranges / max(n, 1))
    drawn = rows.where(F.xxhash64("id", "h", F.lit("cut")).bitwiseAND(2**30 - 1) < int(share * 2**30))
    # rows that repeat an id and a text are one key; nulls come first
    keys = drawn.select("id", "h").distinct().agg(F.sort_array(F.collect_list(F.struct("id", "h"))).alias("k"))
    picked = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("k", F.floor(F.size("k").cast("long") * i / ranges).cast("int")))
    cuts = keys.select(F.array_distinct(F.filter(picked, lambda x: x.isNotNull())).alias("cuts")).scalar()
    rows = rows.withColumn("cuts", cuts).withColumn("range", place(F.col("cuts"), F.struct("id", "h"), ranges)).drop("cuts")
    # the first key of each range, as many rows as there are ranges
    first = rows.groupBy("range").agg(F.min(F.struct("id", "h")).alias("f")).select("range", "f.id", "f.h")
    found = sorted(first.collect(), key=lambda r: r["range"])
    if not found:
        return rows.select("range", F.lit(False).alias("ghost"), "id", "h", "text")
    before = [(found[k - 1]["range"], r["range"], r["id"], r["h"]) for k, r in enumerate(found)]
    borders = F.broadcast(spark.createDataFrame(before, f"before int, of int, first_id {kind}, first_h long"))
    ghosts = rows.join(borders, (F.col("range") == F.col("of")) & F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    ghosts = ghosts.groupBy("before").agg(F.min(F.struct(F.col("text").isNotNull().alias("known"), "text")).alias("t"))
    ghosts = ghosts.select(F.col("before").alias("range"), F.lit(True).alias("ghost"), F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("h"), F.col("t.text").alias("text"))
    return rows.select("range", F.lit(False).alias("ghost"), "id", "h", "text").unionByName(ghosts).repartition(parts, "range")


def place(cuts: Column, key: Column, most: int) -> Column:
    """How many of the sorted cuts, fewer than `most`, are at most the key, by bisection inside one expression."""
    steps = [F.lit(2**i) for i in range(most.bit_length(), -1, -1)]
    past = lambda at, s: (at + s <= F.size(cuts)) & (F.get(cuts, at + s - 1) <= key)
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, s: F.when(past(at, s), at + s).otherwise(at))


def edited_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sigs, edited, edited_sigs, next_sigs) of every row: the second half of a text's code points replaced by
    as many from the start of the next text."""
    rows = with_signatures(with_next(df, id_col, text_col), F.col("text"), "sigs")
    over = Window.partitionBy("range").orderBy("ghost", F.col("id").asc_nulls_first(), "h", F.col("text").asc_nulls_first())
    rows = rows.withColumns({"next": F.lead("text").over(over), "next_sigs": F.lead("sigs").over(over)}).where(~F.col("ghost"))
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(after, F.lit(1), half))
    rows = rows.select("id", text.alias("text"), "sigs", edited.alias("edited"), "next_sigs")
    return with_signatures(rows, F.col("edited"), "edited_sigs")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(fingerprint class pairs a, b, likeness) and (id, class): texts by fingerprint, and the classes alike by `least` or
    more. Classes without signatures are alike to nothing."""
    rows = with_signatures(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text"), "sigs", chains=True)
    rows = staged(rows.select("id", "sigs", F.sha2(fingerprint(F.col("sigs")), 256).alias("class")), "spots")
    sets = staged(rows.where(F.size("sigs") > 0).groupBy("class").agg(F.first("sigs").alias("sigs")), "spotsets")
    counts = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("c"))
    n = F.size("sigs")
    needed = n - F.ceil(F.lit(least) * n - F.lit(1e-9)) + 1
    ranked = sets.select("class", F.explode("sigs").alias("sig")).join(counts.where("c > 1"), "sig").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("c", "sig"))).alias("l"))
    posted = ranked.join(sets, "class").withColumn("many", (needed - (n - F.size("l"))).cast("int")).where("many > 0")
    # partitions by set length: a likeness of `least` needs lengths at most one partition apart
    band = F.floor(F.ln(n) / F.lit(-math.log(least))).cast("int")
    posted = posted.select("class", n.alias("n"), band.alias("band"), F.explode(F.slice("l", F.lit(1), F.col("many"))).alias("x"))
    left = posted.select(F.col("class").alias("a"), F.col("n").alias("na"), "x.sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = posted.select(F.col("class").alias("b"), F.col("n").alias("nb"), "x.sig", "band")
    met = left.join(right, ["sig", "band"]).where((F.col("na") <= F.col("nb")) & (F.col("na") >= least * F.col("nb") - 1e-9))
    pairs = met.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("sigs").alias("sb")), "b")
    alike = pairs.select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)
    return alike, rows.select("id", "class")
