"""Quality rules with risk-controlled thresholds, as DataFrame expressions only.

Each rule rejects a text whose measure is above a cutoff. Cutoffs come from labelled texts, split in
two by a hash of the id. On the holdout part a cutoff is certified if an exact binomial test rejects,
at the corrected level, that it throws out more than its share of good texts; cutoffs of a rule are
tested from the laxest inwards and testing stops at the first failure, so one rule of one stratum
needs no further correction, and rules and strata share the error probability (Bonferroni). Among
certified cutoffs, the other part picks the laxest of those that reject most bad texts, provided
that what they reject is mostly bad. With probability ``1 - error`` every stratum therefore
loses no more than ``risk`` of its good texts to these rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.llm.common import blank_words

WINDOW = 8
SYMBOLS = "[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """Reject if ``measure > low + step * j`` for the chosen cutoff ``j`` of 0 to ``cutoffs - 1``."""

    name: str
    measure: str
    low: float
    step: float
    cutoffs: int = 64


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", 0.0, 1 / 64),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.0, 1 / 64),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0.0, 1 / 64),
    Rule("stutter", "n_stutter / greatest(n_words, 1)", 0.0, 1 / 64),
    Rule("long_words", "word_chars / greatest(n_words, 1)", 4.0, 0.25),
    Rule("short_words", "-word_chars / greatest(n_words, 1)", -8.0, 0.125),
)
#: Languages with cutoffs of their own; all others and null share one.
STRATA = ("de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "ru", "zh")
RISK, ERROR, MOSTLY_BAD = 0.05, 0.05, 0.8
#: Lower terms of a binomial sum that are added one by one; the rest enters by its geometric bound.
TERMS = 4000


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts the rules use: ``n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stutter`` (long). Null and empty texts have zero everywhere. Columns of these
    names are replaced. Everything happens within the row: nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c not in COUNTS]
    step = docs.select(
        *kept,
        blank_words(F.col(text_col)).alias("__w"),
        F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != "").alias("__l"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
    )
    step = step.select(
        *kept,
        "n_symbols",
        "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    done = [c for c in step.columns if c not in ("__w", "__h")]
    stutter = F.size(F.filter("__h", lambda h, i: (i > 0) & (h == F.col("__h")[i - 1])))
    step = step.select(*done, "__w", stutter.cast("long").alias("n_stutter"), "__h")
    # hashes of runs of 2, 4 and 8 words, each from two of the one before
    for width in (1, 2, 4):
        rest = F.greatest(F.size("__h") - width, F.lit(0))
        pair = F.zip_with(F.slice("__h", 1, rest), F.slice("__h", width + 1, rest), lambda a, b: F.xxhash64(a, b))
        step = step.select(*done, "n_stutter", "__w", pair.alias("__h"))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    ranked = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select(*done, "n_stutter", "__w", F.when(repeats, ranked).alias("__s"))

    def same(a: Column, b: Column) -> Column:
        words = F.slice("__w", a["i"] + 1, WINDOW) == F.slice("__w", b["i"] + 1, WINDOW)
        return (a["h"] == b["h"]) & words

    # equal windows are neighbours in the order of their hashes
    twice = F.filter(
        "__s",
        lambda s, k: ((k > 0) & same(s, F.col("__s")[k - 1]))
        | ((k < F.size("__s") - 1) & same(s, F.col("__s")[k + 1])),
    )
    starts = F.sort_array(F.transform(twice, lambda s: s["i"].cast("long")))
    step = step.select(*done, "n_stutter", starts.alias("__p"))
    begin = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "__p",
        begin,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return step.select(*done, "n_stutter", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def stratum(lang: Column, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise("other")


def bins(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """For each rule the number of its cutoffs below the measure: cutoff ``j`` rejects if ``j`` is less."""
    return [
        F.expr(
            f"cast(least({r.cutoffs}D, greatest(0D, ceil((({r.measure}) - ({r.low!r}D)) / {r.step!r}D))) as int)"
        ).alias(f"bin_{r.name}")
        for r in rules
    ]


def thresholds(
    measured: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    strata: tuple[str, ...] = STRATA,
    risk: float = RISK,
    error: float = ERROR,
    mostly_bad: float = MOSTLY_BAD,
) -> DataFrame:
    """``stratum`` and, for each rule, ``cut_<rule>``: the chosen cutoff, null if none is certified.

    ``measured`` has ``doc_id, stratum``, the bins and ``base_failed``; texts that fail the base are
    left out. ``labels`` has ``doc_id, quality``; null ids and null labels are ignored, and of
    several labels of an id the largest holds. The result has one row per stratum with a cutoff, at
    most ``len(strata) + 1``. Without labels no cutoff is certified and there are no rows.
    """
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).dropna()
    digest = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int")
    rows = (
        measured.where(~F.col("base_failed"))
        .join(known, "doc_id")
        .select(
            "stratum",
            (F.col("quality") == 1).alias("good"),
            (digest % 3 != 0).alias("holdout"),
            F.inline(
                F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"bin_{r.name}").alias("bin")) for r in rules])
            ),
        )
    )
    counted = rows.groupBy("stratum", "rule", "bin").agg(
        F.count_if(F.expr("good and holdout")).alias("hold_good"),
        F.count_if(F.expr("good and not holdout")).alias("fit_good"),
        F.count_if(F.expr("not good and not holdout")).alias("fit_bad"),
    )
    # one row per cutoff, so that cutoffs without a text of their own are tested too
    every = [F.struct(F.lit(r.name).alias("rule"), F.sequence(F.lit(0), F.lit(r.cutoffs)).alias("bins")) for r in rules]
    grid = (
        measured.sparkSession.range(1)
        .select(F.explode(F.array(*map(F.lit, (*strata, "other")))).alias("stratum"))
        .select("stratum", F.inline(F.array(*every)))
        .select("stratum", "rule", F.explode("bins").alias("bin"))
    )
    whole = Window.partitionBy("stratum", "rule")
    above = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    laxer = whole.orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.join(counted, ["stratum", "rule", "bin"], "left").select(
        "stratum",
        "rule",
        F.col("bin").alias("cutoff"),
        F.coalesce(F.sum("hold_good").over(whole), F.lit(0)).alias("n"),
        *[
            F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("hold_good", "fit_good", "fit_bad")
        ],
    )
    level = error / (len(rules) * (len(strata) + 1))
    share = risk / len(rules)
    tested = sums.withColumn("p", at_most(F.col("n"), F.col("hold_good"), share))
    tested = tested.withColumn("certified", F.max("p").over(laxer) <= level)
    useful = (F.col("fit_bad") > 0) & (F.col("fit_bad") >= mostly_bad * (F.col("fit_bad") + F.col("fit_good")))
    chosen = tested.where(F.col("certified") & useful).groupBy("stratum")
    return chosen.pivot("rule", [r.name for r in rules]).agg(
        F.max_by("cutoff", F.struct("fit_bad", "cutoff"))
    ).select("stratum", *[F.col(r.name).alias(f"cut_{r.name}") for r in rules])


def at_most(n: Column, k: Column, share: float) -> Column:
    """P(X <= k) of a binomial X of n trials: the exact test's p-value of "more than ``share``".

    Summed from the largest term down. Where k is over the mean the answer is given as 1; terms
    beyond ``TERMS`` enter by their geometric bound, which errs to the safe side.
    """
    n, k = n.cast("double"), k.cast("double")
    odds = (1 - share) / share
    first = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * log(share) + (n - k) * log(1 - share)
    )
    many = F.least(k, F.lit(float(TERMS))).cast("int")
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i) * odds / (n - k + i + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    left = k - many  # terms not added; each is smaller than the last by this factor at least
    ratio = left * odds / (n - left + 1)
    total = F.aggregate(
        steps, begin, add, lambda a: a["total"] + F.when(left > 0, a["term"] * ratio / (1 - ratio)).otherwise(0.0)
    )
    return F.when(k >= n * share, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * total))


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 10."""
    y = x + 10
    product = F.lit(0.0)
    for i in range(1, 11):
        product = product + F.log(x + i)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y + 0.5) * F.log(y) - y + 0.9189385332046727 + series - product


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if no cutoff of the text's stratum rejects it; rules without a cutoff reject nothing."""
    passed = F.lit(True)
    for r in rules:
        cut = F.col(f"cut_{r.name}")
        passed = passed & (cut.isNull() | (F.col(f"bin_{r.name}") <= cut))
    return passed


def judged(measured: DataFrame, cuts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``kept``, in place of a column of that name; ``cut_<rule>`` columns of the input are left out.

    The cutoffs have a row per stratum of a fixed list, so they may be broadcast. Without cutoffs, as for
    an empty or unlabelled table, only the base decides.
    """
    measured = measured.drop(*[f"cut_{r.name}" for r in rules])
    joined = measured.join(F.broadcast(cuts), "stratum", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def with_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, stratum, bins and ``base_failed`` of each row; a missing ``lang`` counts as null.

    Input columns of these names are replaced. Null and empty texts fail the base. Repeated rows each have a
    result. An empty table gives no rows.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.drop("stratum", "base_failed", *[f"bin_{r.name}" for r in rules])
    return measures(docs).select(
        "*", stratum(lang).alias("stratum"), F.expr(BASE_FAILED).alias("base_failed"), *bins(rules)
    )
