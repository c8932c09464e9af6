import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veldtext import cli
from veldtext.config import ScanConfig
from veldtext.functions import patterns as P
from veldtext.operators import bloom, report
from veldtext.operators import heuristics as H
from veldtext.operators.match import compile_signatures
from veldtext.operators.scan import classify, scan
from veldtext.plans import catalogue, corpus
from veldtext.sources import signatures as S
from veldtext.sources.files import decoded, listed, pattern_file, spread, stored_files, text_files

SALT = bytes(range(100, 116))
PATTERNS = ["copper lantern beside a slow river", "wooden bridge under grey clouds", "seven maps for old harbours", "garden walls behind seventy tall poplars"]


@pytest.fixture(scope="module")
def found(spark):
    return compile_signatures(spark.createDataFrame([(p,) for p in [*PATTERNS, "only three words"]], "pattern string"), SALT)


def results(spark, found, *texts, config=ScanConfig(), name="t.md"):
    rows = spark.createDataFrame([(f"{k}/{name}", t) for k, t in enumerate(texts)], "path string, text string")
    return {int(r.path.split("/")[0]): r for r in scan(rows, found, config).collect()}


def test_scores(spark, found):
    import base64

    inner = base64.b64encode(b"\ngarden walls behind seventy tall poplars\n").decode()
    flat = base64.b64encode(b"garden walls behind seventy tall poplars").decode()
    got = results(
        spark, found,
        "only three words",
        "only three words\ncopper lantern beside a slow river",
        f"x {flat} y",
        f"x {inner} y",
        "zero​‌‍﻿width",
        None,
        "",
        "\n".join(PATTERNS + ["COPPER lantern, beside a slow river!"]),
    )
    assert (got[0].score, got[0].findings, got[0].line) == (0.0, [], None)
    assert (got[1].score, got[1].findings, got[1].line) == (20.0, ["hash_match(2)"], 1)
    assert (round(got[2].score, 6), got[2].findings) == (3.9, ["base64_blocks(1)", "encoding_obfuscation"])
    assert round(got[3].score, 6) == 21.233333 and got[3].line == 2
    assert got[3].findings == ["hash_match(1)", "imperative_ratio(0.66)", "base64_blocks(1)", "encoding_obfuscation"]
    assert (got[4].score, got[4].findings) == (0.0, ["encoding_obfuscation"])
    assert (got[5].score, got[5].severity_name) == (0.0, "CLEAN") and (got[6].score, got[6].findings) == (0.0, [])
    assert got[7].findings[0] == "hash_match(5)" and got[7].score >= 40


def test_repeated_rows_count_by_themselves(spark, found):
    rows = spark.createDataFrame([("a.md", PATTERNS[0])] * 2, "path string, text string")
    assert [r.findings[0] for r in scan(rows, found).collect()] == ["hash_match(1)"] * 2


def test_foreign_signatures_are_probed(spark, found):
    closed = S.Signatures(found.salt, bloom.Bloom.of([], 128, 7), found.hashes)
    assert results(spark, closed, PATTERNS[0])[0].findings == []
    same = S.from_bytes(S.to_bytes(found))
    assert results(spark, same, PATTERNS[0])[0].findings == ["hash_match(1)"]


def test_details_are_cut_off(spark):
    rows = spark.createDataFrame([(0.57,), (0.58,), (1.0,), (0.05,)], "x double").select(H.detail_of_share("r", F.col("x")).alias("d"))
    assert [r.d for r in rows.collect()] == ["r(0.56)", "r(0.57)", "r(1.00)", "r(0.05)"]


def test_window_and_array_forms_agree(spark):
    texts = ["The a. " * 4 + "Run it. " * 5, "Run it. " * 9, "The a. " * 5 + "Do x. The b. Do y. Do z. The c.", "The a. " * 3 + "Do it. " * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    by_array = {r.k: r["shift"] for r in H.measured(rows).where("shift is not null").select("k", "shift").collect()}
    from veldtext.functions.text import imperative, sentences

    flagged = rows.select("k", F.posexplode(sentences(F.col("content"))).alias("pos", "s")).withColumn("imperative", imperative(F.col("s")))
    assert {r.k: r["shift"] for r in H.register_shifts(flagged, "k").collect()} == by_array != {}


def test_classes(spark):
    cases = [(0, 80, 0), (19.9, 80, 0), (20, 80, 1), (49.9, 80, 1), (50, 80, 2), (79.9, 80, 2), (80, 80, 3), (100, 80, 3), (60, 60, 3), (25, 30, 1), (35, 30, 3)]
    rows = spark.createDataFrame([(float(s), float(t), w) for s, t, w in cases], "s double, t double, w int")
    assert [r for r in rows.select(classify(F.col("s"), F.col("t")).alias("g"), "w").collect() if r.g != r.w] == []


def test_filter():
    digests = [bytes([k % 256, k // 256]) * 16 for k in range(1000)]
    made = bloom.Bloom.of(digests, *bloom.sizing(1000, 0.01))
    assert made.test(digests).all()
    assert (bloom.sizing(1000, 0.01), bloom.sizing(100, 2.0), bloom.sizing(0, 0.01), bloom.sizing(298980, 0.001)) == ((9592, 7), (960, 7), (16, 12), (4298616, 10))
    with pytest.raises(ValueError):
        bloom.Bloom(128, 7, b"\0")


def test_container(tmp_path, found):
    file = str(tmp_path / "x.pgsig")
    S.write(file, found, b"key")
    again = S.read(file, b"key")
    assert (again.hashes, again.bloom, again.salt) == (found.hashes, found.bloom, found.salt) and found.hashes[0] in again
    data = bytearray(S.to_bytes(found, b"key"))
    data[-5] ^= 1
    for bad in (bytes(data), b"PSIG1", b"", b"XSIG" + bytes(data[4:])):
        with pytest.raises(S.SignatureError):
            S.verify(bad, b"key")
    with pytest.raises(S.SignatureError):
        S.from_bytes(b"garbage that is long enough to be a header of a file")
    assert S.salt_of("abc") == b"abc" + bytes(13) and len(S.salt_of("x" * 40)) == len(S.salt_of()) == 16


def test_listing(tmp_path, spark):
    for name, size, _, _ in corpus.FILE_ROWS:
        if size < 1000:
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_bytes(b"x" * size)
    names = [p.removeprefix(f"{tmp_path}/") for p, _ in listed(str(tmp_path))]
    assert set(names) == {n for n, size, kept, _ in corpus.FILE_ROWS if kept and size < 1000}
    assert names.index("a/x.md") < names.index("a-b.md")
    assert {p.removeprefix(f"{tmp_path}/") for p, _ in listed(str(tmp_path), ScanConfig(recursive=False))} == {n for n, s, _, flat in corpus.FILE_ROWS if flat and s < 1000}
    assert listed(str(tmp_path / "a/x.md"), ScanConfig(max_file_size=1)) and not listed(str(tmp_path / "code.go"))
    with pytest.raises(OSError):
        listed(str(tmp_path / "nothing"))
    assert {r.path for r in text_files(spark, str(tmp_path)).collect()} == {p for p, _ in listed(str(tmp_path))}
    assert decoded(b"a\xff\xfeb\xc3\xa9") == "a��bé"


def test_stored_files(tmp_path, spark):
    (tmp_path / "a").mkdir()
    for name, data in {"x.md": b"a\xffb\xc3\xa9", "a/y.TXT": b"yes", "empty.md": b"", "z.go": b"no", "big.md": b"x" * 100, ".env": b"unseen", "a/no": b"no"}.items():
        (tmp_path / name).write_bytes(data)

    def names(config):
        return {r.path.rpartition(f"{tmp_path}/")[2]: (r.length, r.text) for r in stored_files(spark, str(tmp_path), config).collect()}

    assert names(ScanConfig(max_file_size=50)) == {"x.md": (5, "a\ufffdb\u00e9"), "a/y.TXT": (3, "yes")}
    assert set(names(ScanConfig(recursive=False))) == {"x.md", "big.md"}


def test_pattern_file(tmp_path, spark):
    (tmp_path / "p").write_text(" one \n# two\n\n" + "x" * 65535 + "\n")
    assert [len(r.pattern) for r in pattern_file(spark, str(tmp_path / "p")).collect()] == [3, 65535]
    (tmp_path / "q").write_text("one\n" + "x" * 65536)
    with pytest.raises(Exception, match="65536 bytes"):
        pattern_file(spark, str(tmp_path / "q")).collect()


def test_spread(spark, monkeypatch):
    rows = spark.range(100).coalesce(1)
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr("veldtext.sources.files.MOST_SPREAD", 1)
    assert spread(rows) is rows


def test_patterns_in_java():
    assert P.java(r"(?i)(?:^|\n)\s*[a-z]+s\[?") == r"(?:\A|\n)[\t\n\f\r ]*[a-zA-Z\u017F\u212A]+[sS\u017F]\[?"
    assert P.java(r"[\s^]\\u[0-9]") == r"[\t\n\f\r ^]\\u[0-9]"


def test_one_pass(spark, found, monkeypatch):
    """Texts are read once, unless the short patterns are too many to look for row by row; the results are the same."""
    from veldtext.operators import match

    rows = spark.createDataFrame([("a.md", PATTERNS[0]), ("b.md", "only three words"), ("c.md", f"Only, three words!\nx {PATTERNS[1]} y"), ("d.md", None)], "path string, text string")
    patterns = spark.createDataFrame([(p,) for p in [*PATTERNS, "only three words"]], "pattern string")
    monkeypatch.setattr(match, "MOST_SHORT", 0)
    many = compile_signatures(patterns, SALT)
    sure = compile_signatures(patterns.where("pattern <> 'only three words'"), SALT)
    assert (len(found.short), many.short, sure.short) == (1, None, ())

    def reads(signatures):
        return scan(rows, signatures)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [path")

    assert reads(found) == reads(sure) == 1 < reads(many)
    got = [{r.path: r.findings for r in scan(rows, s).collect()} for s in (found, many, S.from_bytes(S.to_bytes(found)))]
    assert got[0] == got[1] == got[2] == {"a.md": ["hash_match(1)"], "b.md": [], "c.md": ["hash_match(1)"], "d.md": []}


def test_long_lists_are_not_broadcast(spark, found, monkeypatch):
    from veldtext.operators import match

    monkeypatch.setattr(match, "MOST_BROADCAST", 0)
    assert results(spark, found, PATTERNS[0], "only three words\n" + PATTERNS[1])[1].findings == ["hash_match(2)"]


def test_reports(spark, found, tmp_path):
    config = ScanConfig(threshold=30)
    rows = spark.createDataFrame([("a/x.md", "\n".join(PATTERNS)), ("a-b.md", "\n".join(PATTERNS)), ("c.md", "clean words only"), ("d.md", "\n".join(PATTERNS[:2]))], "path string, text string")
    out = scan(rows, found, config)
    text = report.console(out, 30, 0.1)
    assert text.index("a/x.md") < text.index("a-b.md") and "CLEAN: 1 files" in text and "Summary: 2 blocked, 0 suspect, 1 warn, 1 clean" in text
    hidden = report.console(out, 30, 0.1, hide=True)
    assert "WARN" not in hidden and "CLEAN" not in hidden
    said = json.loads(report.report_json(out, 30))
    clean = next(r for r in said["results"] if r["path"] == "c.md")
    assert clean == {"path": "c.md", "score": 0, "severity": 0} and said["total_files"] == 4 and report.exit_status(out) == 2
    assert json.loads(report.report_json(out.where("false"), 30))["results"] is None
    report.write_json(out, str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["path"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a-b.md", "a/x.md", "c.md", "d.md"]


def test_command_line(tmp_path, spark, capsys, monkeypatch):
    monkeypatch.delenv(S.KEY_VARIABLE, raising=False)
    (tmp_path / "p.txt").write_text("# list\n\n" + "\n".join(PATTERNS))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("\n".join(PATTERNS))
    file, folder = str(tmp_path / "s.pgsig"), str(tmp_path / "in")
    assert cli.main(["compile", "-i", str(tmp_path / "p.txt"), "-o", file, "-s", "salt"], spark) == 0
    assert cli.main(["verify", file]) == 0 and cli.main(["verify", file, "--key", "other"]) == 1
    assert cli.main(["scan", folder, "--sigfile", file, "-t", "30"], spark) == 2
    assert cli.main(["scan", folder, "--sigfile", file, "--json", "-t"], spark) == 0
    assert cli.main(["scan", folder, "--sigfile", file, "--key", "other"], spark) == 1
    assert cli.main(["scan", folder, "--nonsense"], spark) == 1 and cli.main(["scan"], spark) == 1 and cli.main([]) == 1 and cli.main(["help"]) == 0
    monkeypatch.setenv(S.KEY_VARIABLE, "other")
    assert cli.main(["scan", folder, "--sigfile", file], spark) == 1
    (tmp_path / "empty.txt").write_text("# nothing\n")
    assert cli.main(["compile", "-i", str(tmp_path / "empty.txt"), "-o", file], spark) == 1
    capsys.readouterr()


def test_stream(spark, tmp_path, found):
    from veldtext.streaming.scan_stream import scan_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([("a.md", PATTERNS[0]), ("b.md", "clean")], "path string, text string").write.parquet(source)
    stream = spark.readStream.schema("path string, text string").parquet(source)
    scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), found).awaitTermination(120)
    assert {r.path: r.findings for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a.md": ["hash_match(1)"], "b.md": []}


def test_sql_names(spark):
    from veldtext.functions import registry

    registry.register(spark)
    assert spark.sql("SELECT normalize_text('A, b') AS x, decode_text('&lt;') AS y").first() == ("a b", "<")
    row = spark.sql("SELECT salted_hash('A, b', X'0102') AS h, ngrams('a B, c!', 2) AS g, ngrams(NULL, 2) AS n, ngrams('a', 2) AS z").first()
    assert bytes(row.h) == hashlib.sha256(b"\x01\x02a b").digest() and (row.g, row.n, row.z) == (["a b", "b c"], None, [])
    texts = spark.createDataFrame([("x/y.md", "You are now a cat\nfrom now on " + "A" * 50)], "path string, content string")
    one = texts.select(
        registry.salted_hash(F.col("content"), b"s").alias("h"), registry.ngrams(F.col("content"), 4).alias("g"), registry.findings(F.col("content"), F.col("path")).alias("f")
    ).first()
    assert bytes(one.h) == hashlib.sha256(b"s" + b"you are now a cat from now on " + b"a" * 50).digest() and len(one.g) == 6
    assert one.f == registry.analyze(texts).first().found and {f.rule for f in one.f} == {"role_reassignment", "encoding_detected"}


@pytest.mark.parametrize("name", ["decode_layers", "file_filter", "classify_scores", "bloom_params", "signature_compile", "scan_full", "quiet_report"])
def test_queries_against_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    want = con.sql(catalogue.ORACLES[name]).df()
    got = catalogue.QUERIES[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(frame):
        return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).map(lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)


def test_gate_probes_every_document(spark, tmp_path):
    """A passage inside a longer line opens the gate; a text without one, or with fewer than four words, does not."""
    import duckdb

    passage = "alpha bravo charlie delta echo foxtrot"
    texts = {8: f"before {passage} after", 16: passage, 24: "nothing of the kind is in here", 32: "alpha bravo charlie", 40: "", 48: f"x\n{passage.upper()}!\ny"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.path: r.bloom_hit for r in catalogue.QUERIES["bloom_gate"](spark, str(tmp_path)).collect()}
    assert got == {f"doc_{i}.md": i in (8, 16, 48) for i in texts}
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert dict(con.sql(catalogue.ORACLES["bloom_gate"]).fetchall()) == got
