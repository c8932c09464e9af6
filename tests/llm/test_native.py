"""Quality rules, sharding and tool calls."""

import json
import random
import re
import zlib
from collections import Counter
from math import comb
from statistics import median

import numpy as np
from llm_tables import prose, table
from pyspark.sql import functions as F

from veldtext.llm import quality, sharding, tool_calls


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(threes)
    inside = {k + j for k, t in enumerate(threes) if often[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n)


TEXTS = ["a b c a b c", "a b c d a b c", "x x x x x", "a b", "", None, "l\n\nl\n l\nl \nm", "# * | <>", "a a a b a a a", "é é ü", "a b c " * 3000, " lead\ttrail \n"]


def test_features(spark, odd_pairs):
    pairs = [*odd_pairs, *((1000 + k, t) for k, t in enumerate(TEXTS))]
    rows = quality.features(table(spark, pairs)).withColumn("base", quality.base_failed()).collect()
    want = sorted((str(i), *counts(t)) for i, t in pairs)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base) for r in rows) == want


def test_tail(spark):
    cases = [(50, 0), (50, 3), (50, 49), (1000, 2), (1000, 45), (1000, 200), (1, 1), (20, 20), (1, 0), (0, 0), (21, 1)]
    rows = spark.createDataFrame(cases, "n long, x long").select("n", "x", quality._tail(F.col("n"), F.col("x"), 0.05).alias("p")).collect()
    for r in rows:
        want = sum(comb(r.n, k) * 0.05**k * 0.95 ** (r.n - k) for k in range(r.x + 1))
        assert abs(r.p - want) < 1e-9


def test_rules_are_bounded_in_each_stratum(spark):
    good = [(k, prose(k, 80, 5000)) for k in range(3000)]
    bad = [(5000 + k, " ".join(w + "###" for w in prose(k, 80, 5000).split())) for k in range(200)]
    docs = table(spark, good + bad).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    labels = spark.createDataFrame([(i, int(i < 5000)) for i, _ in good + bad] + [(0, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.quality_rules(docs, labels).collect()
    assert len(rows) == 3200
    kept = {r.doc_id: r.kept for r in rows}
    assert not any(kept[i] for i, _ in bad)
    for half in (0, 1):
        assert sum(not kept[i] for i, _ in good if i % 2 == half) <= 0.01 * 1500
    limits = quality.cutoffs(quality.features(docs, stratum_col="lang"), labels).collect()
    assert {r.stratum for r in limits} == {"", "en"} and all(r.n_rejected <= 0.01 * r.n_good for r in limits)


def test_verdict_by_brute_force(spark):
    """Levels, tails and verdicts by their definition: en is large enough for rules, de and null are not."""
    rng = random.Random(11)
    pairs, labels = [], []
    for k in range(900):
        words = prose(k, 70, 4000).split()
        if k % 9 == 0:
            words = [w + rng.choice(("#", "!", "", "$$")) for w in words]
        elif k % 50 == 1:
            words += words[:20]
        elif k % 50 == 2:
            words = [w.upper() if rng.random() < 0.2 else w for w in words]
        pairs.append((k, " ".join(words[: 40 if k % 31 == 0 else None])))
        labels.append((k, int(k % 9 != 0)))
    lang = {k: "en" if k < 700 else "de" if k < 850 else None for k in range(900)}
    base = table(spark, pairs)
    docs = base.withColumn("lang", F.when(F.col("doc_id") < 700, "en").when(F.col("doc_id") < 850, "de"))
    proposes = {r.doc_id: r.p for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(quality.PROPOSE)) == 0).alias("p")).collect()}
    measure, failed = {}, {}
    for k, text in pairs:
        n, chars, symbols, dups, repeats, failed[k] = counts(text)
        upper, marks = sum(c.isupper() for c in text), sum(c in "!?" for c in text)
        measure[k] = [symbols / chars, repeats / n, dups / 1, upper / chars, marks / n, chars / n, -chars / n]
    cuts = {}
    strata = {s: [k for k in measure if (lang[k] or "") == s and not failed[k]] for s in ("en", "de", "")}
    for s, rows in strata.items():
        good = [k for k in rows if labels[k][1]]
        first, test = [k for k in good if proposes[k]], [k for k in good if not proposes[k]]
        if not first:
            continue
        top = [max(measure[k][m] for k in first) for m in range(7)]
        spread = [max(top[m] - median(measure[k][m] for k in first), least) for m, (_, least) in enumerate(quality.MEASURES.values())]
        best = None
        for level in quality.LEVELS:
            cut = [t + x * level for t, x in zip(top, spread, strict=True)]
            beyond = lambda k: any(v > c for v, c in zip(measure[k], cut, strict=True))  # noqa: B023, E731
            x, n = sum(map(beyond, test)), len(test)
            if sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(x + 1)) > 0.05 / 3:
                break
            bad = sum(beyond(k) for k in rows if not labels[k][1])
            if best is None or bad > best[0]:
                best = bad, cut
        if best:
            cuts[s] = best[1]
    assert all(any(proposes[k] and labels[k][1] for k in rows) for rows in strata.values()) and cuts.keys() == {"en"}
    want = {k: not failed[k] and not any(v > c for v, c in zip(measure[k], cuts.get(lang[k] or "", [9e9] * 7), strict=True)) for k in measure}
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.02).collect()}
    assert got == want and sum(want.values()) < sum(not f for f in failed.values())


def test_rules_without_labels(spark, odd_pairs):
    docs = table(spark, odd_pairs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality_rules(docs, none).collect()
    assert len(rows) == len(odd_pairs) and all(r.kept != r.base_failed for r in rows)
    assert not quality.quality_rules(docs.where("false"), none).collect()


def one_by_one(sizes, n_shards):
    """Longest processing time first, a group at a time: the shard of each of the falling sizes."""
    loads, out = [0] * n_shards, []
    for size in sorted(sizes, reverse=True):
        shard = loads.index(min(loads))
        loads[shard] += size
        out.append(shard)
    return out


def test_schedule_is_that_of_all_groups_one_by_one():
    rng = random.Random(4)
    for trial in range(300):
        sizes = [rng.randint(1, (3, 40, 1000)[trial % 3]) for _ in range(rng.randint(0, 200))] + [rng.randint(1, 9000)] * (trial % 4)
        sizes += [7] * rng.choice((0, 500))
        n = rng.choice((1, 2, 5, 16))
        plan = sharding.schedule(list(Counter(sizes).items()), n)
        assert sharding.shard_of(plan, np.arange(len(sizes))).tolist() == one_by_one(sizes, n)


def test_placed_groups(spark, monkeypatch):
    """Sizes of many groups in several parts: each size has as many groups in each shard as one by one."""
    monkeypatch.setattr(sharding, "PART", 20)
    rng = random.Random(6)
    sizes = [rng.choice((5, 5, 5, 9, 12, 700, rng.randint(1, 60))) for _ in range(600)]
    groups = spark.createDataFrame([(bytearray(zlib.crc32(b"%d" % k).to_bytes(4, "big") + b"%d" % k), s) for k, s in enumerate(sizes)], "grp binary, bytes long")
    rows = sharding.placed_groups(groups, 5).join(groups, "grp").collect()
    assert len(rows) == 600
    want = Counter(zip(sorted(sizes, reverse=True), one_by_one(sizes, 5), strict=True))
    assert Counter((r.bytes, r.shard) for r in rows) == want


def test_shards(spark, odd_pairs):
    pairs = [*odd_pairs, *((2000 + k, prose(k, 5 + k % 90)) for k in range(800)), *((4000 + k, "same text " * 4) for k in range(50))]
    rows = sharding.shard_documents(table(spark, pairs)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    shard_of, loads = {}, Counter()
    texts = {i: t or "" for i, t in pairs}
    for r in rows:
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r.size
    for s in set(shard_of.values()):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    groups = Counter()
    for _, t in pairs:
        groups[t or ""] += len((t or "").encode()) + 1
    want = Counter()
    for size, shard in zip(sorted(groups.values(), reverse=True), one_by_one(groups.values(), 16), strict=True):
        want[shard] += size
    assert loads == want
    assert not sharding.shard_documents(table(spark, pairs).where("false")).collect()


SCHEMAS = {
    "add": {"a": ("integer", True, 0, 10), "b": ("number", False, None, 5.5), "tags": ("array", False, None, None)},
    "say": {"text": ("string", True, 1, 3), "loud": ("boolean", False, None, None), "how": ("object", False, None, None)},
}


def test_calls(spark):
    calls = [
        (1, 0, "p", "add", '{ "b" : 2.5, "a":1 }', []),
        (1, 1, "q", "say", '{"text":"abcd","loud":1,"x":null}', ["p"]),
        (1, 2, "r", "say", '{"text":"ab","how":{"z":[1, {"y":2,"x":"ü\\n"}],"a":true}}', ["q", "p", "nothing"]),
        (1, 3, "s", "add", '{"a":1}', ["t"]),
        (1, 4, "t", "add", '{"a":99}', ["s"]),
        (1, 5, "u", "add", '{"a":1}', ["t"]),
        (1, 6, "p", "add", '{"a":2}', []),
        (2, 0, None, "add", '{"a":3}', []),
        (2, 1, "v", "none", "{}", []),
        (2, 2, "w", "add", "not json", None),
        (2, 3, "x", "add", None, ["x"]),
        (2, 4, "y", "add", "[1]", []),
        (None, None, "z", "add", '{"a":4.5}', ["r", "r"]),
    ]
    results = [(3, "p", "late"), (1, "p", "first"), (9, "q", None), (1, "nobody", "x"), (1, None, "x"), (None, "z", "end")]
    out = tool_calls.link_calls(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>"),
        spark.createDataFrame(results, "turn long, call_id string, content string"),
        SCHEMAS,
    ).collect()
    assert len(out) == len(calls)
    got = {(r.conv_id, r.turn): r for r in out}
    assert json.loads(got[1, 0].message) == {"arguments": {"a": 1, "b": 2.5}, "id": "p", "result": "first", "tool": "add"}
    assert (got[1, 0].arguments, got[1, 0].linked, got[1, 0].n_results, got[1, 0].result_turn, got[1, 0].valid) == ('{"a":1,"b":2.5}', True, 2, 1, True)
    assert got[1, 1].problems == "type:loud,range:text,unknown:x" and got[1, 1].linked
    assert got[1, 2].arguments == '{"how":{"a":true,"z":[1,{"x":"ü\\n","y":2}]},"text":"ab"}' and got[1, 2].valid and not got[1, 2].linked
    assert [got[1, k].level for k in range(7)] == [0, 1, 2, None, None, None, None]
    assert got[1, 4].problems == "range:a" and got[1, 6].problems == "duplicate" and not got[1, 6].linked
    assert (got[2, 0].problems, got[2, 1].problems, got[2, 2].problems, got[2, 3].problems, got[2, 4].problems) == ("id", "tool", "json", "json", "json")
    assert got[2, 2].arguments is None and got[2, 3].level is None and got[None, None].level == 3 and got[None, None].problems == "type:a"


def test_no_calls(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, more int")
    assert not tool_calls.link_conversations(none).collect()


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (1, None, "user", "y"), (1, 2, "user", 'q"\\ \u0001'), (1, 2, "system", "s"), (2, 0, None, "z")]
    out = tool_calls.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 5 and sum(r.linked for r in out) == 2
    again = next(r for r in out if r.turn == 2)
    assert json.loads(again.arguments)["text"] == 'q"\\ \u0001' and again.level == 0
