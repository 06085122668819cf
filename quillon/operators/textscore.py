"""Comparing texts: multiset precision, recall and F1 of words, character error rate, rule-based language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|(?:(?![\p{IsHan}\p{IsHiragana}\p{IsKatakana}])[\p{L}\p{N}])+"

# fixed values: common function words of the languages told apart by them, and script shares
FUNCTION_WORDS = {
    "en": "the and of to in is that for with are was this",
    "de": "der die das und ist nicht ein eine mit von zu den",
    "fr": "le la les des et est une dans pour que qui pas",
    "es": "el los las que una del por con para es se su",
    "it": "il gli che non una del per con sono della nel di",
    "pt": "os as que uma para com não do da em dos são",
    "nl": "de het een en van dat niet met voor zijn ook te",
}
SCRIPTS = [
    ("ja", r"[぀-ヿ]", 0.05),
    ("ko", r"[ᄀ-ᇿ㄰-㆏가-힯]", 0.1),
    ("zh", r"[㐀-䶿一-鿿]", 0.3),
    ("th", r"[฀-๿]", 0.3),
    ("el", r"[Ͱ-Ͽ]", 0.3),
    ("he", r"[֐-׿]", 0.3),
    ("ar", r"[؀-ۿ]", 0.3),
    ("hi", r"[ऀ-ॿ]", 0.3),
]
CYRILLIC, RUSSIAN, UKRAINIAN = r"[Ѐ-ӿ]", r"(?iu)[ыэъ]", r"(?iu)[іїєґ]"
LEAST_HITS, LEAD = 3, 1.5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def overlap(df: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """(key, ref, hyp, common): sizes of two word multisets and of their intersection, from counts per word."""
    both = df.select(key, F.explode(words(F.col(reference))).alias("w"), F.lit(1).alias("r"), F.lit(0).alias("h")).unionByName(
        df.select(key, F.explode(words(F.col(hypothesis))).alias("w"), F.lit(0).alias("r"), F.lit(1).alias("h"))
    )
    counts = both.groupBy(key, "w").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    return counts.groupBy(key).agg(F.sum("r").alias("ref"), F.sum("h").alias("hyp"), F.sum(F.least("r", "h")).alias("common"))


def item_scores(df: DataFrame, key: str, truth: str, candidate: str) -> DataFrame:
    """(key, kind, truth, candidate, precision, recall) of two multisets of items `kind|...`, by kind, as far as either
    side has any; from counts per item."""
    side = lambda c, a, b: df.select(key, F.explode(c).alias("item"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counts = side(truth, 1, 0).unionByName(side(candidate, 0, 1)).groupBy(key, "item").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    kinds = counts.groupBy(key, F.substring_index("item", "|", 1).alias("kind")).agg(F.sum("a").alias("truth"), F.sum("b").alias("candidate"), F.sum(F.least("a", "b")).alias("common"))
    share = lambda n: F.coalesce(F.try_divide("common", n), F.lit(0.0))
    return kinds.select(key, "kind", "truth", "candidate", share("candidate").alias("precision"), share("truth").alias("recall"))


def f1(common: Column, ref: Column, hyp: Column) -> Column:
    return F.when(common == 0, F.lit(0.0)).otherwise(2 * common / (ref + hyp))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits per hundred characters of the reference."""
    return 100 * F.levenshtein(reference, hypothesis) / F.char_length(reference)


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of a text are in a class, from the length of the text without all others."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", ""))


def detect_language(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the language where the evidence is clear, else null: a script's share of the letters, or function words well
    ahead of any other language's. Script shares are only taken of texts that hold a letter beyond the Latin ones."""
    t = F.col(text)
    df = df.withColumns({"_words": F.split(F.lower(t), r"[^\p{L}]+"), "_letters": count_chars(t, r"\p{L}"), "_beyond": t.rlike(r"[Ͱ-힯]")})
    among = lambda known: F.size(F.filter("_words", lambda w: w.isin(*known)))
    hits = F.array(*[F.struct(among(v.split()).alias("hits"), F.lit(-i).alias("o"), F.lit(k).alias("lang")) for i, (k, v) in enumerate(FUNCTION_WORDS.items())])
    df = df.withColumn("_hits", F.reverse(F.array_sort(hits)))
    best, second = F.col("_hits")[0], F.col("_hits")[1]
    ru, uk = F.regexp_count(t, F.lit(RUSSIAN)), F.regexp_count(t, F.lit(UKRAINIAN))
    share = lambda chars: count_chars(t, chars.strip("[]")) / F.col("_letters")
    script = F.when(F.lit(False), F.lit(None).cast("string"))
    for lang, chars, least in SCRIPTS:
        script = script.when(share(chars) >= least, lang)
    cyrillic = share(CYRILLIC) >= 0.3
    script = script.when(cyrillic, F.when(ru > uk, "ru").when(uk > ru, "uk").otherwise("none"))
    latin = F.when((best.hits >= LEAST_HITS) & (best.hits >= second.hits * LEAD), best.lang)
    answer = F.when(F.col("_letters") == 0, F.lit(None)).otherwise(F.coalesce(F.when(F.col("_beyond"), script), latin))
    return df.withColumn(out, F.nullif(answer, F.lit("none"))).drop("_words", "_letters", "_beyond", "_hits")
