"""Quality rules as a short-circuit cascade.

A rule is a predicate over measures, and a measure is an expression over the text or over other measures. On a sample,
each rule's rejection rate is counted and its cost timed, from the text on, so with all measures that it needs; rules are
ordered by rejection per cost. Rules are then tried one after the other, and a rule's measures are made only for texts
that no earlier rule has rejected: a text that a cheap rule rejects never meets the windows of eight words.

The order depends on clocks, the verdicts don't: a text stays if no rule rejects it, and failed_rule, of texts that go,
is the first rule in the order in which the rules were given.

Everything is native: no Python runs on executors, and no row leaves its partition, so there is no shuffle and no
group that could be hot.

Defined results: a null text has no words, counts as empty and fails the base rules; so does an empty text. Very long
texts are measured whole. Repeated rows are judged one by one. An empty table gives an empty result. All working
columns carry a prefix of their own, so input columns of any other name survive unchanged.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, spread, staged

P = "__quality_"
#: Rows, about, from which cost and selectivity are estimated, drawn at random with a fixed seed; only the order of the
#: rules depends on them.
SAMPLE_ROWS = 512
#: Characters of a text that the estimate looks at; the rules themselves always see whole texts.
SAMPLE_CHARS = 20_000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A name, the measures that it needs, and the condition under which a text is rejected."""

    name: str
    needs: tuple[str, ...]
    rejects: Column


def covered(n: int = 8) -> Column:
    """Words in windows that occur twice or more, from the sorted (hash, place) pairs. A pair counts if a neighbour has its
    hash; the spans of the pairs that count are united from left to right."""
    order = P + "order"
    return F.expr(
        f"""aggregate(
              array_sort(transform(
                filter(
                  transform(`{order}`, (x, k) -> struct(x.i AS i,
                    (k > 0 AND `{order}`[greatest(k - 1, 0)].h = x.h)
                    OR (k < size(`{order}`) - 1 AND `{order}`[least(k + 1, size(`{order}`) - 1)].h = x.h) AS again)),
                  x -> x.again),
                x -> x.i)),
              named_struct('n', 0L, 'end', -1),
              (a, i) -> named_struct('n', a.n + {n} - greatest(a.end - i, 0), 'end', i + {n}),
              a -> a.n)"""
    )


def _list_measures() -> dict[str, tuple[tuple[str, ...], Callable[[], Column]]]:
    """Measures by name: what each needs, and its expression."""
    c = lambda name: F.col(P + name)
    long = lambda x: x.cast("long")
    n_of = lambda pattern: F.char_length(F.regexp_replace(c("t"), pattern, ""))
    pairs = lambda of, apart: (
        lambda rest: F.zip_with(F.slice(of, F.lit(1), rest), F.slice(of, F.lit(apart + 1), rest), lambda a, b: F.xxhash64(a, b))
    )(F.greatest(F.size(of) - apart, F.lit(0)))
    # texts without a repeated window, by far the most, skip the sort
    again = F.size(F.array_distinct(c("eights"))) < F.size(c("eights"))
    return {
        "bare": (("t",), lambda: F.btrim(c("t"), F.lit(BLANKS))),
        "words": (("bare",), lambda: F.when(c("bare") == "", F.array().cast("array<string>")).otherwise(F.split(c("bare"), SPACE))),
        "lines": (("t",), lambda: F.filter(F.split(c("t"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")),
        "n_words": (("words",), lambda: long(F.size(c("words")))),
        "chars": (("t",), lambda: long(F.char_length(c("t")))),
        "word_chars": (("t",), lambda: long(F.char_length(F.translate(c("t"), BLANKS, "")))),
        "n_symbols": (("t",), lambda: long(F.char_length(c("t")) - F.char_length(F.translate(c("t"), SYMBOLS, "")))),
        "n_lines": (("lines",), lambda: long(F.size(c("lines")))),
        "n_dup_lines": (("lines",), lambda: long(F.size(c("lines")) - F.size(F.array_distinct(c("lines"))))),
        # hashes of words, of two neighbours, of four words, of eight: none where the text is shorter
        "ones": (("words",), lambda: F.transform(c("words"), lambda w: F.xxhash64(w))),
        "twos": (("ones",), lambda: pairs(c("ones"), 1)),
        "fours": (("twos",), lambda: pairs(c("twos"), 2)),
        "eights": (("fours",), lambda: pairs(c("fours"), 4)),
        "order": (("eights",), lambda: F.when(again, F.array_sort(F.transform(c("eights"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))),
        "n_repeat_words": (("order",), lambda: F.when(c("order").isNotNull(), covered()).otherwise(F.lit(0)).cast("long")),
        "n_shouts": (("t",), lambda: long(F.when(F.instr(c("t"), "!!") > 0, F.regexp_count(c("t"), F.lit(r"!{2,}"))).otherwise(F.lit(0)))),
        "n_bars": (("words",), lambda: long(F.size(c("words")) - F.size(F.array_remove(c("words"), "|")))),
        "n_letters": (("t",), lambda: long(n_of(r"[^\p{L}]+"))),
        "n_capitals": (("t",), lambda: long(n_of(r"[^\p{Lu}]+"))),
    }


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_measures(df: DataFrame, text: str, names: tuple[str, ...], only: Column | None = None) -> DataFrame:
    """df with the prefixed measures and all that they need, as far as it hasn't got them; null where `only` doesn't hold."""
    known = _list_measures()
    if P + "t" not in df.columns:
        df = df.withColumn(P + "t", F.coalesce(F.col(f"`{text}`"), F.lit("")))

    def add(df: DataFrame, name: str) -> DataFrame:
        if P + name in df.columns:
            return df
        needs, make = known[name]
        for n in needs:
            df = add(df, n)
        return df.withColumn(P + name, make() if only is None else F.when(only, make()))

    for name in names:
        df = add(df, name)
    return df


def base_rules() -> list[Rule]:
    n = F.col(P + "n_words")
    return [
        Rule("few_words", ("n_words",), n < 20),
        Rule("repeats", ("n_words", "n_repeat_words"), 100 * F.col(P + "n_repeat_words") > 30 * n),
    ]


def base_failed() -> Column:
    few, repeats = base_rules()
    return few.rejects | repeats.rejects


def default_rules() -> list[Rule]:
    """Rules in the spirit of published web-text filters. All of them leave ordinary prose alone."""
    c = lambda name: F.col(P + name)
    n, chars = c("n_words"), c("word_chars")
    return [
        Rule("symbols", ("chars", "n_symbols"), c("n_symbols") > 0.10 * F.greatest(c("chars"), F.lit(1))),
        Rule("word_length", ("n_words", "word_chars"), (chars < 2 * n) | (chars > 25 * n)),
        Rule("duplicate_lines", ("n_lines", "n_dup_lines"), 2 * c("n_dup_lines") > c("n_lines")),
        Rule("shouting", ("n_words", "n_shouts"), c("n_shouts") / F.greatest(n, F.lit(1)) > 0.25),
        Rule("bars", ("n_words", "n_bars"), 5 * c("n_bars") > n),
        Rule("letters", ("word_chars", "n_letters"), c("n_letters") < 0.5 * chars),
        Rule("capitals", ("word_chars", "n_capitals"), c("n_capitals") > 0.5 * chars),
    ]


def estimate(df: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds a row) on about `rows` rows. The sample is drawn row by row, so that neither the
    order of the table nor a group of copies decides it, and is staged; the time of a rule is that of its measures and its
    test, less that of reading the sample."""
    share = min(1.0, rows / max(df.count(), 1))
    drawn = df.select(F.substring(F.col(f"`{text}`"), 1, SAMPLE_CHARS).alias("text"))
    drawn = drawn if share == 1.0 else drawn.sample(False, share, 17).limit(2 * rows)
    sample = staged(drawn, "sample").coalesce(1)
    many = sample.count()
    if not many:
        return [(r, 0.0, 1.0) for r in rules]

    def timed(found: DataFrame) -> tuple[float, int]:
        best, out = 1e9, 0
        for _ in range(2):
            began = time.perf_counter()
            out = found.collect()[0][0]
            best = min(best, time.perf_counter() - began)
        return best, out

    idle, _ = timed(sample.agg(F.count_if(F.octet_length("text") < 0)))
    out = []
    for r in rules:
        took, hits = timed(with_measures(sample, "text", r.needs).agg(F.count_if(r.rejects)))
        out.append((r, hits / many, max(took - idle, 1e-3) / many))
    return out


def ordered(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejection per cost, highest first; ties by cost, then by name."""
    return [r for r, share, cost in sorted(estimates, key=lambda x: (-x[1] / max(x[2], 1e-9), x[2], x[0].name))]


def cascade(df: DataFrame, rules: list[Rule], text: str) -> DataFrame:
    """df with the prefixed column failed: the first rule, in this order, that rejects a text. A rule's measures are made
    only where no rule before it has rejected."""
    failed = F.col(P + "failed")
    if P + "failed" not in df.columns:
        df = df.withColumn(P + "failed", F.lit(None).cast("string"))
    for r in rules:
        df = with_measures(df, text, r.needs, failed.isNull())
        df = df.withColumn(P + "failed", F.coalesce(failed, F.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name))))
    return df


def judge(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """df with the prefixed base measures, base_failed, kept, and failed_rule: null if the text is kept, `base` if a base
    rule rejects it, else the first of the given rules that does. To filter by it, use keep(): the planner would push a
    filter below the steps that build the measures, and build them anew for each use."""
    rules = default_rules() if rules is None else rules
    best = ordered(estimate(df, rules, text))
    out = with_measures(spread(df), text, BASE).withColumn(P + "base_failed", base_failed())
    out = cascade(out.withColumn(P + "failed", F.when(F.col(P + "base_failed"), F.lit("base"))), best, text)
    failed = F.col(P + "failed")
    # which of several rules is named must not depend on the measured order: the others are looked at where one rejects
    known = _list_measures()
    later = [n for r in rules for n in r.needs]
    for name in dict.fromkeys(n for n in later if known[n][0] == ("t",) or n == "n_bars"):
        out = out.withColumn(P + name, F.coalesce(P + name, F.when(failed.isNotNull() & (failed != "base"), known[name][1]())))
    named = F.when(F.lit(False), F.lit(""))
    for r in rules:
        named = named.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name))
    rule = F.when(failed == "base", failed).when(failed.isNotNull(), named)
    out = out.withColumns({P + "kept": failed.isNull(), P + "failed_rule": rule})
    columns = [*df.columns, *[P + n for n in (*BASE, "base_failed", "kept", "failed_rule")]]
    return out.select(*[F.col(f"`{n}`") for n in columns])


def keep(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of df that pass the base rules and the given ones, all in one measured order, with the columns of df. A
    filter would be pushed below the projections that build the measures step by step, and so build them anew for each
    use; a generator of one row or none stays above them."""
    rules = base_rules() + (default_rules() if rules is None else rules)
    judged = cascade(spread(df), ordered(estimate(df, rules, text)), text)
    once = F.when(F.col(P + "failed").isNull(), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    own = [F.col(f"`{c}`") for c in df.columns]
    return judged.select(*own, F.explode(once).alias(P + "once")).select(*own)
