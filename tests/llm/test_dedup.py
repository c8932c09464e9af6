"""Exact, near and suffix dedup against brute force, with odd rows."""

from collections import Counter

import brute
import numpy as np
import pytest
from llm_tables import near, prose, table
from pyspark.sql import functions as F

from veldtext.llm import bwt, exact_dedup, language_id, near_dedup, suffix_dedup

def test_exact(spark, odd_pairs):
    got = [tuple(r) for r in exact_dedup.exact_groups(table(spark, odd_pairs)).collect()]
    assert sorted(got, key=str) == brute.exact(odd_pairs)


def test_exact_survivors(spark, odd_pairs):
    docs = table(spark, odd_pairs)
    out = exact_dedup.survivors(docs)
    assert out.columns == docs.columns
    norms = [brute.BLANK.sub("", r.text or "") for r in out.collect()]
    assert len(norms) == len(set(norms)) == len({brute.BLANK.sub("", t or "") for _, t in odd_pairs})


def near_rows(rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=str)


def test_near(spark, odd_pairs):
    got = near_dedup.near_components(table(spark, odd_pairs)).collect()
    assert near_rows(got) == sorted(brute.near(odd_pairs), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_rest_in_small_blocks(spark, monkeypatch, seed):
    """A group in which many are not near the hub: the exhaustive part decides, in blocks of few members and guests."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "MEMBERS", 2)
    monkeypatch.setattr(near_dedup, "GUESTS", 3)
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", 20 * (seed - 1))
    base = prose(seed, 100, 3000)
    pairs = [(k, near(base, 100 * seed + k, 1 + k % 8)) for k in range(60)]
    got = near_dedup.near_components(table(spark, pairs), hub_rounds=1).collect()
    assert near_rows(got) == sorted(brute.near(pairs), key=str)


def test_near_links_through_ids(spark):
    """Rows that repeat an id with other texts: each links by its own set, and all of them by the id."""
    one, two, three = (prose(600 + k, 100, 3000) for k in range(3))
    pairs = [(5, one), (5, two), (7, near(one, 1, 1)), (9, near(two, 2, 1)), (3, near(two, 3, 1)), (5, ""), (6, three), (6, three), (8, None), (8, three)]
    docs = table(spark, pairs)
    got = near_dedup.near_components(docs).collect()
    assert near_rows(got) == sorted(brute.near(pairs), key=str)
    assert {r.doc_id: r.component_id for r in got} == {3: 3, 5: 3, 7: 3, 9: 3, 6: 6, 8: 6}
    assert sorted((r.doc_id, r.text) for r in near_dedup.survivors(docs).collect()) == [(3, pairs[4][1]), (6, three), (6, three)]


def test_all_pairs_within_the_distance_are_confirmed():
    """Of two signatures that differ in DISTANCE of the symbols that make the keys, in any of them, a key is shared and
    the pair is confirmed, whatever the rest of the longer signature says."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 2**16, near_dedup.SCREEN).astype(np.uint16)
        b = rng.integers(0, 2**16, near_dedup.SCREEN).astype(np.uint16)
        b[: near_dedup.SYMBOLS] = a[: near_dedup.SYMBOLS]
        b[rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)] += 1
        assert near_dedup._near(a, b) and near_dedup._meeting(a[None], b[None])[0] >= 0


def test_survivors_with_clashing_names(spark, odd_pairs):
    names = ["row key", "own id", "own node", "kept id", "own_id", "kept_id", "whole", "node", "text key"]
    docs = table(spark, odd_pairs[:40]).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for out in (near_dedup.survivors(docs), exact_dedup.survivors(docs), language_id.survivors(docs)):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (102, 100)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}


def test_null_id_in_near(spark):
    got = near_dedup.near_components(table(spark, [(None, prose(1, 50)), (3, prose(2, 50))])).collect()
    assert {r.doc_id: r.component_id for r in got} == {None: None, 3: 3}


def test_near_survivors_without_ids(spark, odd_pairs):
    """Rows without an id link like others, give way to an id, and stay where nothing is near."""
    base, other, lone = prose(501, 100, 3000), prose(502, 100, 3000), prose(503, 100, 3000)
    pairs = [(7, base), (None, near(base, 1, 1)), (None, other), (None, near(other, 2, 1)), (None, lone), (None, None), (None, "")]
    pairs += [(9, near(lone, 3, 40)), (None, lone)]
    docs = table(spark, pairs)
    out = near_dedup.survivors(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    pair = {other, near(other, 2, 1)}
    assert sum(t in pair for _, t in got) == 1
    assert sorted((i, t) for i, t in got if i is not None) == [(7, base), (9, pairs[7][1])]
    assert sorted(str(t) for i, t in got if i is None and t not in pair) == sorted(["", "None", lone, lone])
    rows = near_dedup.near_components(docs).collect()
    assert len(rows) == len(pairs) and sorted(r.component_id for r in rows if r.component_id is not None) == [7, 7, 9]
    assert sum(r.kept for r in rows) == len(got)


@pytest.mark.parametrize(("hot", "block", "shard"), [(50_000, 600_000, 1 << 18), (2, 3_000, 400), (50_000, 1, 2_000)])
def test_suffix(spark, odd_pairs, monkeypatch, hot, block, shard):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "STEP", 5_000)
    monkeypatch.setattr(bwt, "SHARD", shard)
    pairs = [(i, t) for i, t in odd_pairs if i != 97]
    pairs += [(110, odd_pairs[0][1] + " other"), (110, odd_pairs[1][1] + " text"), (None, "x" * 70), (None, "x" * 70), (111, "x" * 300), (112, "xyz" * 90)]
    got = [tuple(r) for r in suffix_dedup.remove_repeats(table(spark, pairs)).collect()]
    assert sorted(got, key=str) == brute.suffix(pairs)


def test_suffix_survivors(spark, odd_pairs):
    docs = table(spark, odd_pairs)
    out = suffix_dedup.survivors(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[97].text == prose(7, 30000, 4000) and rows[97].n_chars == len(rows[97].text)
    assert 90 not in rows and 81 not in rows and prose(99, 60, 3000) not in rows[62].text


@pytest.mark.parametrize(("shard", "letters"), [(50, 2), (1 << 18, 2), (300, 256), (7, 1)])
def test_merged_transforms(monkeypatch, shard, letters):
    """Against a dictionary of all windows, in strings that share some anchors."""
    monkeypatch.setattr(bwt, "SHARD", shard)
    rng = np.random.default_rng(5)
    window, anchor = 14, 8
    for _ in range(25):
        anchors = [rng.integers(0, letters, anchor, np.uint8).tobytes() for _ in range(3)]
        strings, ahead, windows = [], [], []
        for _ in range(60):
            a = int(rng.integers(0, window - anchor + 1))
            m = int(rng.integers(1, a + 2))
            before, behind = rng.integers(0, letters, a, np.uint8), rng.integers(0, letters, m + window - anchor - 1 - a, np.uint8)
            strings.append(before.tobytes() + anchors[rng.integers(3)] + behind.tobytes())
            ahead.append(a)
            windows.append(m)
        owners, sizes = rng.integers(0, 6, 60), np.array([len(x) for x in strings])
        least = {}
        for x, a, m, o in zip(strings, ahead, windows, owners.tolist(), strict=True):
            for i in range(m):
                least[a - i, x[i : i + window]] = min(least.get((a - i, x[i : i + window]), 99), o)
        rows = zip(strings, ahead, windows, owners.tolist(), strict=True)
        want = [sum((least[a - i, x[i : i + window]] < o) << i for i in range(m)) for x, a, m, o in rows]
        data = np.frombuffer(b"".join(strings), np.uint8)
        got = bwt.repeats(data, np.cumsum(sizes) - sizes, np.array(ahead), np.array(windows), owners, window, anchor)
        assert got.tolist() == want


def test_suffix_survivors_with_clashing_names(spark, odd_pairs):
    names = ["row key", "row", "left", "left_text", "whole", "id", "block", "data"]
    docs = table(spark, odd_pairs[:40]).drop("row", "block").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    out = suffix_dedup.survivors(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).where("false")
    assert not exact_dedup.exact_groups(none).collect() and not exact_dedup.survivors(none).collect()
    assert not near_dedup.near_components(none).collect() and not near_dedup.survivors(none).collect()
    assert not suffix_dedup.remove_repeats(none).collect() and not suffix_dedup.survivors(none).collect()


def test_windows_cover_counter():
    """Equal windows have equal anchors wherever they stand."""
    text = prose(3, 60).encode()
    data = np.frombuffer(b"q" * 37 + text + b"w" * 11 + text, np.uint8)
    value = suffix_dedup.anchors(suffix_dedup.grams(data))
    seen = {}
    for p in range(len(value)):
        seen.setdefault(data[p : p + 50].tobytes(), set()).add(int(value[p]))
    assert Counter(map(len, seen.values())).keys() == {1}
