"""Structural heuristics: findings of rules on one text, as Column expressions.

A finding is struct(rule, score, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldtext.functions import patterns as P
from veldtext.functions.text import imperative_flags, lines
from veldtext.operators.decode import is_html


def count_of(text: Column, *patterns: str) -> Column:
    """How often patterns in RE2's dialect match, in all."""
    counts = [F.regexp_count(text, F.lit(P.java(p))) for p in patterns]
    return sum(counts[1:], counts[0])


def detail(rule: str, n: Column) -> Column:
    return F.concat(F.lit(rule + "("), n.cast("string"), F.lit(")"))


def detail_of_share(rule: str, share: Column) -> Column:
    """Two decimals, cut off and not rounded."""
    rest = F.abs(((share - F.floor(share)) * 100).cast("int"))
    return F.format_string(rule + "(%d.%02d)", F.floor(share).cast("int"), rest)


def finding(when: Column, rule: str, score: Column, said: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), score.cast("double").alias("score"), said.alias("detail")))


def measures(text: Column) -> dict[str, Column]:
    """What the rules on whole texts count. As columns of their own, each pattern runs once."""
    return {
        "n_lines": F.size(lines(text)),
        "n_targets": count_of(text, *P.TARGETS),
        "n_roles": count_of(text, *P.ROLES),
        "n_directives": count_of(text, *P.DIRECTIVES),
        "n_blocks": count_of(text, P.BASE64),
        "n_escapes": count_of(text, P.ESCAPE),
        "n_entities": count_of(text, P.ENTITY),
        "n_invisible": count_of(text, P.INVISIBLE),
    }


def imperative_share(flags: Column) -> Column:
    """Null for fewer than three sentences."""
    return F.when(F.size(flags) >= 3, F.size(F.filter(flags, lambda f: f)) / F.size(flags))


def largest_shift(flags: Column) -> Column:
    """The largest share of sentences, of five before and five from a place, that turn from telling to ordering."""

    def shift(i: Column) -> Column:
        told = sum((F.when(F.get(flags, i - k), 0).when(F.get(flags, i - k).isNull(), 0).otherwise(1) for k in range(1, 6)), F.lit(0))
        asked = sum((F.when(F.get(flags, i + k), 1).otherwise(0) for k in range(5)), F.lit(0))
        return F.when((told >= 3) & (asked >= 3), (told + asked) / 10)

    return F.when(F.size(flags) >= 6, F.array_max(F.transform(F.sequence(F.lit(3), F.size(flags) - 3), shift)))


def imperative_ratio(share: Column) -> Column:
    return finding(share >= 0.4, "imperative_ratio", F.least(share * 5, F.lit(5.0)), detail_of_share("imperative_ratio", share))


def system_targets(hits: Column, n_lines: Column) -> Column:
    score = F.least(hits / n_lines * 2, F.lit(2.0))
    score = F.when(hits >= 5, F.least(score + 0.5, F.lit(2.0))).otherwise(score)
    return finding(hits >= 3, "system_targets", score, detail("system_targets", hits))


def role_assignment(hits: Column) -> Column:
    return finding(hits > 0, "role_reassignment", F.lit(5.0), detail("role_assign_structure", hits))


def directive_override(hits: Column) -> Column:
    return finding(hits > 0, "role_reassignment", F.least(hits * 3.0, F.lit(10.0)), detail("directive_override_structure", hits))


def encodings(blocks: Column, escapes: Column, entities: Column, invisible: Column, path: Column) -> list[Column]:
    return [
        finding(blocks > 0, "encoding_detected", F.lit(3.0), detail("base64_blocks", blocks)),
        finding(escapes >= 3, "encoding_detected", F.lit(0.8), detail("unicode_escapes", escapes)),
        finding(~is_html(path) & (entities >= 5), "encoding_detected", F.lit(0.5), detail("html_entities_in_non_html", entities)),
        finding(invisible > 0, "encoding_detected", F.lit(5.0), detail("zero_width_chars", invisible)),
    ]


def register_break(shift: Column) -> Column:
    return finding(shift >= 0.5, "register_break", F.least(shift * 8, F.lit(8.0)), detail_of_share("tonal_shift_score", shift))


def measured(rows: DataFrame, text: str = "content") -> DataFrame:
    """rows with the measures and, from the sentences, share and shift.

    The flags depend on a row number that changes nothing. It keeps the optimizer from putting their expression in the
    place of each use, in a later filter above all, where it would run once for every sentence.
    """
    once = F.when(F.monotonically_increasing_id() >= 0, imperative_flags(F.col(text)))
    out = rows.withColumns({**measures(F.col(text)), "flags": once})
    return out.withColumns({"share": imperative_share(F.col("flags")), "shift": largest_shift(F.col("flags"))}).drop("flags")


def _found(m: dict[str, Column], share: Column, shift: Column, name: Column) -> Column:
    """All findings, in the fixed order of the rules."""
    found = [
        imperative_ratio(share), system_targets(m["n_targets"], m["n_lines"]), role_assignment(m["n_roles"]), directive_override(m["n_directives"]),
        *encodings(m["n_blocks"], m["n_escapes"], m["n_entities"], m["n_invisible"], name), register_break(shift),
    ]
    return F.array_compact(F.array(*found))


def findings(text: Column, path: Column) -> Column:
    """All findings of the heuristics in a text, as an array; path tells whether it is HTML."""
    flags = imperative_flags(text)
    return _found(measures(text), imperative_share(flags), largest_shift(flags), F.substring_index(path, "/", -1))


def analyzed(rows: DataFrame) -> DataFrame:
    """rows (path, content, ...) with found, as :func:`findings` gives them; each pattern runs once a text."""
    found = _found({m: F.col(m) for m in measures(F.col("content"))}, F.col("share"), F.col("shift"), F.substring_index("path", "/", -1))
    return measured(rows).select(*[F.col(f"`{c}`") for c in rows.columns], found.alias("found"))


def register_shifts(sentences: DataFrame, *key: str) -> DataFrame:
    """The largest shift for each key, by window functions; sentences: key columns, pos (from 0), imperative."""
    order = Window.partitionBy(*key).orderBy("pos")
    told = F.sum(F.when(F.col("imperative"), 0).otherwise(1)).over(order.rowsBetween(-5, -1))
    asked = F.sum(F.when(F.col("imperative"), 1).otherwise(0)).over(order.rowsBetween(0, 4))
    rows = sentences.withColumns({"told": told, "asked": asked, "n": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    rows = rows.where("n >= 6 and pos >= 3 and pos <= n - 3 and told >= 3 and asked >= 3")
    return rows.groupBy(*key).agg(F.max((F.col("told") + F.col("asked")) / 10).alias("shift"))


def total(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0.0), lambda a, f: a + f["score"])
