"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Each rule compares one measure of a text with a cutoff and rejects what lies beyond it; a text goes if any rule rejects
it. The cutoffs of all rules of a stratum are selected together, on labelled holdout rows. A sixteenth of the good rows
proposes: each measure's largest value there, and its spread (from the median to that value). A level puts every cutoff
so many spreads beyond the largest value, and the levels of LEVELS run from lenient to strict. The other good rows test
them in this order: the hypothesis "the rules of this level together reject more than a share `risk` of the stratum's
good texts" is dropped if the exact binomial tail P(Bin(n, risk) <= x), for x of n rows rejected, is at most `doubt`
divided by the number of strata (Bonferroni). The first hypothesis that stands ends the sequence, so that the levels of a
stratum need no correction among themselves. With probability 1 - doubt at least, no level before it rejects more than
`risk` of the good texts in any stratum. In force are the rules of that one of them which rejects most bad labelled
rows, the most lenient of several; if there is none, the stratum has no rules.

Defined results: a null text has no words; a null stratum is the stratum ''; a stratum without labels has no rules, so
that only the base decides; repeated rows get equal results (labels repeated for an id count once, the best quality of
them holding); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldtext.llm.common import SPACES, WORD, empty_if_null, materialize, squeezed

#: Measures of which a larger value is worse, as expressions on the features, and the least spread of each.
MEASURES = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", 0.01),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", 0.05),
    "duplicate_line_share": ("n_dup_lines / greatest(n_lines, 1)", 0.05),
    "upper_share": ("n_upper / greatest(word_chars, 1)", 0.02),
    "mark_share": ("n_marks / greatest(n_words, 1)", 0.02),
    "long_word_mean": ("word_chars / greatest(n_words, 1)", 0.5),
    "short_word_mean": ("- word_chars / greatest(n_words, 1)", 0.5),
}
#: Spreads beyond the largest value that the proposing rows have, from lenient to strict.
LEVELS = (8.0, 4.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05, 0.0)
#: One in so many good rows proposes. The others test, so that no hypothesis depends on the rows that test it.
PROPOSE = 16


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that a text has twice or more, each once.

    The windows are compared as text. Hashes only decide whether a text needs that: equal windows have equal hashes.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(
        starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    windows = F.sort_array(
        F.transform(
            starts,
            lambda i: F.struct(
                F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")
            ),
        )
    )
    return F.when((n > 3) & (F.size(F.array_distinct(hashes)) < n - 2), windows)


def _covered(windows: Column) -> Column:
    """Of sorted (window, place) pairs, the number of words under the windows that occur twice or more."""
    twice = F.filter(
        windows,
        lambda x, j: (F.get(windows, j - 1)["w"] == x["w"]) | (F.get(windows, j + 1)["w"] == x["w"]),
    )
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    folded = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")
        ),
    )
    return folded["n"]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, stratum and the counts that the measures use."""
    gaps = "[" + "".join(f"\\x{ord(c):02x}" for c in SPACES) + "]+"
    text = empty_if_null(F.col(text_col))
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), text.alias("t"))
    rows = rows.select(
        "doc_id",
        "stratum",
        "t",
        squeezed(F.col("t")).alias("solid"),
        F.filter(F.split("t", gaps), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        F.regexp_count("solid", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("solid", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("solid", F.lit("[!?]")).cast("long").alias("n_marks"),
        _repeated_words(F.col("words")).alias("windows"),
    )
    return rows.withColumn("n_repeat_words", F.coalesce(_covered(F.col("windows")), F.lit(0).cast("long"))).drop("windows")


def _log_factorial(n: Column) -> Column:
    """By Stirling's series, which beyond 20 is exact to the last digits of a double."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(
        x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + series
    )


def _tail(n: Column, x: Column, p: float) -> Column:
    """P(Bin(n, p) <= x): the term of x, and those below it until they no longer count."""
    first = _log_factorial(n) - _log_factorial(x) - _log_factorial(n - x) + x * math.log(p) + (n - x) * math.log(1 - p)
    terms = F.greatest(x - n * p, F.lit(0.0)) + 20 * F.sqrt(n.cast("double")) + 100
    summed = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(x, terms.cast("long"))),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, k: F.struct(
            (a["term"] * (x - k) * (1 - p) / ((n - x + k + 1) * p)).alias("term"), (a["sum"] + a["term"]).alias("sum")
        ),
    )
    return F.when(x >= n, 1.0).otherwise(F.least(F.exp(first) * summed["sum"], F.lit(1.0)))


def _measures() -> list[Column]:
    return [F.expr(f"double({e})").alias(m) for m, (e, _) in MEASURES.items()]


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, good, proposes and the measures of the holdout rows. Those that the base rejects do not count: the rules
    never see them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = rows.where(~base_failed()).join(known.where("quality is not null"), "doc_id")
    good = F.col("quality") == 1
    return held.select("stratum", good.alias("good"), (good & (F.pmod(F.xxhash64("doc_id"), F.lit(PROPOSE)) == 0)).alias("proposes"), *_measures())


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = 0.01, doubt: float = 0.05) -> DataFrame:
    """One row per rule of each stratum that has rules in force: stratum, rule, cutoff, level, n_good, n_rejected,
    n_bad, tail.

    rows: features; labels: doc_id and quality (1 is good, 0 bad). A text beyond a cutoff (greater than it) is rejected.
    n_rejected and n_bad count the good test rows and the bad rows that any rule of the level rejects. Strata are few
    (languages); what is broadcast has one row for each.
    """
    held = materialize(labelled_rows(rows, labels))
    proposed = held.where("proposes").groupBy("stratum").agg(
        *[F.struct(F.max(m).alias("top"), F.greatest(F.max(m) - F.median(m), F.lit(least)).alias("spread")).alias(f"at_{m}") for m, (_, least) in MEASURES.items()]
    )  # a row for each stratum

    def cutoff(measure: str, level: Column | float) -> Column:
        return F.col(f"at_{measure}.top") + F.col(f"at_{measure}.spread") * level

    def rejected(level: float, among: Column) -> Column:
        out = F.lit(False)
        for m in MEASURES:
            out = out | (F.col(m) > cutoff(m, level))
        return F.count_if(among & out)

    at = [f"at_{m}" for m in MEASURES]
    counted = materialize(
        held.where(~F.col("proposes"))
        .join(F.broadcast(proposed), "stratum")
        .groupBy("stratum", *at)
        .agg(
            F.count_if("good").alias("n_good"),
            F.array(*[rejected(level, F.col("good")) for level in LEVELS]).alias("n_rejected"),
            F.array(*[rejected(level, ~F.col("good")) for level in LEVELS]).alias("n_bad"),
        )
    )
    strata = max(1, counted.count())
    levels = F.array(*[F.lit(x) for x in LEVELS])
    n = F.col("n_good")
    # The tail matters only where fewer are rejected than expected; this bounds its terms.
    tails = F.transform("n_rejected", lambda x: F.when(x <= n * risk, _tail(n, x, risk)).otherwise(1.0))
    tested = counted.withColumn("tails", tails)
    fails = F.filter(F.sequence(F.lit(0), F.lit(len(LEVELS) - 1)), lambda k: F.get("tails", k) > doubt / strata)
    passed = tested.withColumn("passed", F.coalesce(F.get(fails, F.lit(0)), F.lit(len(LEVELS)))).where("passed > 0")
    bad = F.slice("n_bad", F.lit(1), F.col("passed"))
    passed = passed.withColumn("at", (F.array_position(bad, F.array_max(bad)) - 1).cast("int")).withColumn("level", F.get(levels, F.col("at")))
    rules = F.array(*[F.struct(F.lit(m).alias("rule"), cutoff(m, F.col("level")).alias("cutoff")) for m in MEASURES])
    counts = [F.get(c, F.col("at")).alias(c) for c in ("n_rejected", "n_bad")]
    return passed.select("stratum", F.explode(rules).alias("r"), "level", "n_good", *counts, F.get("tails", F.col("at")).alias("tail")).select(
        "stratum", "r.rule", "r.cutoff", "level", "n_good", "n_rejected", "n_bad", "tail"
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with base_failed, kept and the names of the rules that reject each."""
    by_stratum = limits.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut")
    )  # a row for each stratum, with at most one entry for each rule
    broken = F.array_compact(
        F.array(
            *[F.when(F.expr(f"double({e})") > F.col("cut").getItem(m), F.lit(m)) for m, (e, _) in MEASURES.items()]
        )
    )
    out = rows.join(F.broadcast(by_stratum), "stratum", "left").withColumn("base_failed", base_failed())
    out = out.withColumn("broken", F.when(F.col("cut").isNull(), F.array().cast("array<string>")).otherwise(broken))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("cut")


def quality_rules(
    docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = 0.01, doubt: float = 0.05
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and the rules that reject it."""
    rows = materialize(features(docs, stratum_col=stratum_col))
    limits = materialize(cutoffs(rows, labels, risk, doubt))
    return judge(rows, limits)
