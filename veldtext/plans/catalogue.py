"""Queries of the scanner's operators, each with DuckDB SQL that gives the same rows.

The SQL is written from the rules, on the texts after decoding where a layer is beyond SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldtext.config import ScanConfig
from veldtext.functions import patterns as P
from veldtext.functions import text as T
from veldtext.operators import bloom, match, report
from veldtext.operators import heuristics as H
from veldtext.operators.decode import decode
from veldtext.operators.scan import classify, scan, severity_name
from veldtext.plans import corpus
from veldtext.plans.corpus import ENDINGS, SALT, quoted
from veldtext.sources.files import listed

QUERIES: dict = {}
ORACLES: dict = {}
#: So that results are blocked in the seeded corpus.
LOW = ScanConfig(threshold=30.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return corpus.documents(spark, sf_dir).select("doc_id", path.alias("path"), "text")


def _signatures(spark: SparkSession, sf_dir: str):
    return match.compile_signatures(corpus.patterns(spark, sf_dir), SALT)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(corpus.seeded(spark, sf_dir), _signatures(spark, sf_dir), LOW)


# ---- SQL parts -------------------------------------------------------------------------------------------------------


def _case(part: int) -> str:
    rows = " ".join(f"WHEN {k} THEN {quoted(e[part]) if part < 2 else e[part]}" for k, e in enumerate(ENDINGS))
    return f"CASE doc_id % {len(ENDINGS)} {rows} END"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_SALT_SQL = "unhex('" + SALT.hex() + "')"


def _salted(x: str) -> str:
    return f"sha256({_SALT_SQL} || encode({x}))"


_SEEDED = f"seeded AS (SELECT doc_id, 'doc_' || doc_id || '.md' AS path, text || {_case(1)} AS content, {_case(2)} AS obf FROM documents)"
_PLAIN = "seeded AS (SELECT doc_id, 'doc_' || doc_id || '.md' AS path, text AS content, 0.0 AS obf FROM documents)"
_STOP = ", ".join(quoted(w) for w in T.STOP_WORDS)
_SENTENCES = rf"""
    parts AS (SELECT doc_id, unnest(string_split_regex(content, '[.!?]+[\t\n\f\r ]+|\n+')) AS s,
                     generate_subscripts(string_split_regex(content, '[.!?]+[\t\n\f\r ]+|\n+'), 1) AS k FROM seeded),
    kept AS (SELECT doc_id, k, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM parts),
    sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, s,
                     lower(regexp_extract(s, '^(\S+)', 1)) AS w FROM kept WHERE s <> ''),
    flagged AS (SELECT doc_id, pos, s,
                       regexp_matches(s, '\s') AND w NOT IN ({_STOP})
                       AND NOT (regexp_matches(w, '(tion|ment|ness|ence|ance)$') AND octet_length(encode(w)) > 6)
                       AND NOT (regexp_matches(w, 'ity$') AND octet_length(encode(w)) > 5)
                       AND regexp_matches(w, '^([a-z]|[^\x00-\x7f\x{{5c0}}-\x{{5ff}}])') AS imp FROM sents)"""
_PATTERNS = f"""
    raw AS (SELECT trim(unnest(string_split(text, chr(10)))) AS p FROM benchmark
            UNION ALL SELECT unnest([{", ".join(quoted(p) for p in corpus.PATTERNS)}])),
    pats AS (SELECT p, {_norm("p")} AS norm FROM raw WHERE p <> '' AND p NOT LIKE '#%'),
    toks AS (SELECT norm, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS ws FROM pats),
    grams AS (SELECT array_to_string(ws[i : i + n - 1], ' ') AS g
              FROM toks, unnest([4, 5, 6]) AS sizes(n), unnest(range(1, greatest(len(ws) - n + 2, 1))) AS places(i))"""
_BITS = f"""
    params AS (SELECT (ceil(-n * ln(0.001) / (ln(2) * ln(2)))::BIGINT + 7) // 8 * 8 AS m, n FROM (SELECT 10 * count(*) AS n FROM pats)),
    sized AS (SELECT m, greatest(ceil(m / n * ln(2)), 1)::BIGINT AS k FROM params)"""


def _position(digest: str) -> str:
    def half(at: int) -> str:
        return f"('0x' || substr({digest}, {at}, 16))::UBIGINT::HUGEINT"

    return f"(({half(1)} + i * {half(17)} + i * i) % 18446744073709551616 % m)::BIGINT"


_LINES = f"""
    linesets AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line,
                        generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM seeded),
    normed AS (SELECT doc_id, line_no, {_norm("line")} AS norm FROM linesets),
    hit AS (SELECT doc_id, line_no, norm FROM normed WHERE norm <> '' AND norm IN (SELECT norm FROM pats)),
    {_BITS}, digests AS (SELECT {_salted("norm")} AS d FROM pats UNION SELECT {_salted("g")} FROM grams),
    setbits AS (SELECT DISTINCT {_position("d")} AS bit FROM digests, sized, unnest(range(0, k)) AS places(i)),
    probes AS (SELECT doc_id, {_salted("g")} AS d FROM (
                SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: array_to_string(ws[i : i + n - 1], ' '))) AS g
                FROM (SELECT doc_id, string_split({_norm("content")}, ' ') AS ws FROM seeded
                      WHERE doc_id IN (SELECT doc_id FROM hit)), unnest([4, 5, 6]) AS sizes(n)) GROUP BY ALL),
    probed AS (SELECT doc_id, d, {_position("d")} AS bit FROM probes, sized, unnest(range(0, k)) AS places(i)),
    gate AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, d, count(*) AS met FROM probed WHERE bit IN (SELECT bit FROM setbits) GROUP BY ALL) WHERE met = (SELECT k FROM sized)),
    matches AS (SELECT doc_id, count(*) AS n, min(line_no) AS line FROM hit WHERE doc_id IN (SELECT doc_id FROM gate) GROUP BY doc_id)"""


def _n(pattern: str, text: str = "content") -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def _sum(*patterns: str) -> str:
    return " + ".join(_n(p) for p in patterns)


_COUNTS = f"""
    counted AS (SELECT doc_id, path, obf, content, len(string_split(content, chr(10))) AS n_lines,
        {_sum(*P.TARGETS)} AS targets, {_sum(*P.ROLES)} AS roles, {_sum(*P.DIRECTIVES)} AS directives, {_n(P.BASE64)} AS blocks,
        {_n(P.ESCAPE)} AS escapes, {_n(P.ENTITY)} AS entities, {_n(P.INVISIBLE)} AS invisible FROM seeded)"""
_RATIO = """
    ratio AS (SELECT doc_id, count(*) AS n, avg(imp::INT) AS r FROM flagged GROUP BY doc_id)"""
_SHIFT = """
    framed AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n,
                      sum((NOT imp)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS told,
                      sum(imp::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS asked FROM flagged),
    shift AS (SELECT doc_id, max((told + asked) / 10.0) AS t FROM framed
              WHERE n >= 6 AND pos >= 3 AND pos <= n - 3 AND told >= 3 AND asked >= 3 GROUP BY doc_id)"""


def _share(rule: str, x: str) -> str:
    rest = f"trunc(({x} - floor({x})) * 100)::INT"
    return f"'{rule}(' || floor({x})::INT || '.' || lpad(({rest})::VARCHAR, 2, '0') || ')'"


_FOUND = f"""
    found AS (SELECT c.doc_id, c.path, c.obf, m.line, CASE WHEN m.n > 0 THEN least(m.n * 10.0, 40.0) ELSE 0.0 END AS hashed,
        CASE WHEN r.n >= 3 AND r.r >= 0.4 THEN least(r.r * 5, 5.0) ELSE 0.0 END AS s1,
        CASE WHEN targets >= 5 THEN least(least(targets / n_lines * 2, 2.0) + 0.5, 2.0) WHEN targets >= 3 THEN least(targets / n_lines * 2, 2.0) ELSE 0.0 END AS s2,
        CASE WHEN roles > 0 THEN 5.0 ELSE 0.0 END AS s3, CASE WHEN directives > 0 THEN least(directives * 3.0, 10.0) ELSE 0.0 END AS s4,
        CASE WHEN blocks > 0 THEN 3.0 ELSE 0.0 END + CASE WHEN escapes >= 3 THEN 0.8 ELSE 0.0 END
        + CASE WHEN entities >= 5 THEN 0.5 ELSE 0.0 END + CASE WHEN invisible > 0 THEN 5.0 ELSE 0.0 END AS s6,
        CASE WHEN s.t >= 0.5 THEN least(s.t * 8, 8.0) ELSE 0.0 END AS s7,
        array_to_string(list_filter([
            CASE WHEN m.n > 0 THEN 'hash_match(' || m.n || ')' END,
            CASE WHEN r.n >= 3 AND r.r >= 0.4 THEN {_share("imperative_ratio", "r.r")} END,
            CASE WHEN targets >= 3 THEN 'system_targets(' || targets || ')' END,
            CASE WHEN roles > 0 THEN 'role_assign_structure(' || roles || ')' END,
            CASE WHEN directives > 0 THEN 'directive_override_structure(' || directives || ')' END,
            CASE WHEN blocks > 0 THEN 'base64_blocks(' || blocks || ')' END,
            CASE WHEN escapes >= 3 THEN 'unicode_escapes(' || escapes || ')' END,
            CASE WHEN entities >= 5 THEN 'html_entities_in_non_html(' || entities || ')' END,
            CASE WHEN invisible > 0 THEN 'zero_width_chars(' || invisible || ')' END,
            CASE WHEN s.t >= 0.5 THEN {_share("tonal_shift_score", "s.t")} END,
            CASE WHEN c.obf > 0 THEN 'encoding_obfuscation' END], lambda x: x IS NOT NULL), ' + ') AS findings
        FROM counted c LEFT JOIN matches m USING (doc_id) LEFT JOIN ratio r USING (doc_id) LEFT JOIN shift s USING (doc_id)),
    scored AS (SELECT *, round(least((hashed + s1 + s2 + s3 + s4 + s6 + s7) * (1 + obf), 100.0), 6) AS score FROM found),
    results AS (SELECT path, score, CASE WHEN score >= 30 THEN 3 WHEN score >= 50 THEN 2 WHEN score >= 20 THEN 1 ELSE 0 END AS severity, findings, line FROM scored),
    named AS (SELECT *, ['CLEAN', 'WARN', 'SUSPECT', 'BLOCKED'][severity + 1] AS severity_name FROM results)"""
_ALL = f"WITH {_SEEDED}, {_SENTENCES}, {_PATTERNS}, {_LINES}, {_COUNTS}, {_RATIO}, {_SHIFT}, {_FOUND}"


def _flat(results: DataFrame) -> DataFrame:
    return results.withColumn("score", F.round("score", 6)).withColumn("findings", F.array_join("findings", " + "))


# ---- Text primitives -------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_norm('text')} AS norm, sha256({_norm('text')}) AS norm_sha256 FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("norm"))
    return rows.withColumn("norm_sha256", F.lower(F.hex(T.sha256(F.col("norm")))))


@query(
    f"""WITH {_PLAIN}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line,
            generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM seeded),
        n AS (SELECT doc_id, line_no, {_norm('line')} AS norm FROM l)
        SELECT doc_id, line_no, len(string_split(norm, ' ')) AS n_words, {_salted('norm')} AS line_hash FROM n WHERE norm <> ''"""
)
def salted_line_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match.line_hashes(_docs(spark, sf_dir), SALT, "doc_id", text="text")
    return rows.withColumn("line_hash", F.lower(F.hex("line_hash")))


@query(
    f"""WITH w AS (SELECT item_id, string_split({_norm('text')}, ' ') AS ws FROM benchmark)
        SELECT item_id, n, i - 1 AS pos, array_to_string(ws[i : i + n - 1], ' ') AS gram
        FROM w, unnest([4, 5, 6]) AS sizes(n), unnest(range(1, greatest(len(ws) - n + 2, 1))) AS places(i)"""
)
def ngram_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "benchmark").select("item_id", T.words(T.normalize(F.col("text"))).alias("ws"))
    parts = [rows.select("item_id", F.lit(n).alias("n"), F.posexplode(T.ngrams(F.col("ws"), n)).alias("pos", "gram")) for n in (4, 5, 6)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH w AS (SELECT doc_id, {_norm('text')} AS norm FROM documents),
        s AS (SELECT doc_id, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n FROM w)
        SELECT doc_id, greatest(n - 3, 0) + greatest(n - 4, 0) + greatest(n - 5, 0) AS n_grams FROM s"""
)
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of every document, counted."""
    rows = _docs(spark, sf_dir).select("doc_id", T.words(T.normalize(F.col("text"))).alias("ws"))
    return rows.select("doc_id", F.size(T.multi_ngrams(F.col("ws"))).cast("long").alias("n_grams"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("imperative", T.imperative(F.col("sentence")))


@query(f"WITH {_PLAIN}, {_SENTENCES} SELECT doc_id, pos, s AS sentence FROM sents")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).drop("imperative")


@query(f"WITH {_PLAIN}, {_SENTENCES} SELECT doc_id, pos, imp AS imperative FROM flagged")
def imperative_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).drop("sentence")


# ---- Heuristics ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_PLAIN}, {_SENTENCES}, {_RATIO}
        SELECT doc_id, round(least(r * 5, 5.0), 6) AS score, {_share('imperative_ratio', 'r')} AS detail FROM ratio WHERE n >= 3 AND r >= 0.4"""
)
def imperative_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.measured(_docs(spark, sf_dir), "text")
    rows = rows.select("doc_id", H.imperative_ratio(F.col("share")).alias("f")).where("f is not null")
    return rows.select("doc_id", F.round("f.score", 6).alias("score"), "f.detail")


@query(f"WITH {_PLAIN}, {_SENTENCES}, {_SHIFT} SELECT doc_id, round(t, 6) AS shift FROM shift")
def register_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By window functions."""
    return H.register_shifts(_flagged(spark, sf_dir), "doc_id").withColumn("shift", F.round("shift", 6))


@query(
    f"""WITH {_PLAIN}, {_SENTENCES}, {_SHIFT}
        SELECT doc_id, round(least(t * 8, 8.0), 6) AS score, {_share('tonal_shift_score', 't')} AS detail FROM shift WHERE t >= 0.5"""
)
def register_break_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a shuffle, as the scan computes it."""
    rows = H.measured(_docs(spark, sf_dir), "text")
    rows = rows.select("doc_id", H.register_break(F.col("shift")).alias("f")).where("f is not null")
    return rows.select("doc_id", F.round("f.score", 6).alias("score"), "f.detail")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(corpus.seeded(spark, sf_dir)).select("doc_id", "path", "content", "obfuscation_score")


def _one(spark: SparkSession, sf_dir: str, found) -> DataFrame:
    rows = _content(spark, sf_dir).withColumns(H.measures(F.col("content"))).select("doc_id", found.alias("f")).where("f is not null")
    return rows.select("doc_id", F.round("f.score", 6).alias("score"), "f.detail")


@query(
    f"""WITH {_SEEDED}, {_COUNTS}
        SELECT doc_id, round(CASE WHEN targets >= 5 THEN least(least(targets / n_lines * 2, 2.0) + 0.5, 2.0) ELSE least(targets / n_lines * 2, 2.0) END, 6) AS score,
               'system_targets(' || targets || ')' AS detail FROM counted WHERE targets >= 3"""
)
def system_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, H.system_targets(F.col("n_targets"), F.col("n_lines")))


@query(f"WITH {_SEEDED}, {_COUNTS} SELECT doc_id, 5.0::DOUBLE AS score, 'role_assign_structure(' || roles || ')' AS detail FROM counted WHERE roles > 0")
def role_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, H.role_assignment(F.col("n_roles")))


@query(
    f"""WITH {_SEEDED}, {_COUNTS} SELECT doc_id, least(directives * 3.0, 10.0)::DOUBLE AS score, 'directive_override_structure(' || directives || ')' AS detail
        FROM counted WHERE directives > 0"""
)
def directive_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, H.directive_override(F.col("n_directives")))


_ENCODINGS = """
    SELECT {key}, details FROM (SELECT {key}, array_to_string(list_filter([
        CASE WHEN blocks > 0 THEN 'base64_blocks(' || blocks || ')' END,
        CASE WHEN escapes >= 3 THEN 'unicode_escapes(' || escapes || ')' END,
        CASE WHEN entities >= 5 {html} THEN 'html_entities_in_non_html(' || entities || ')' END,
        CASE WHEN invisible > 0 THEN 'zero_width_chars(' || invisible || ')' END], lambda x: x IS NOT NULL), ',') AS details FROM counted) WHERE details <> ''"""


def _encoding_details(rows: DataFrame, key: str) -> DataFrame:
    counts = [F.col(c) for c in ("n_blocks", "n_escapes", "n_entities", "n_invisible")]
    found = F.array_compact(F.array(*H.encodings(*counts, F.col("path"))))
    return rows.withColumns(H.measures(F.col("content"))).select(key, F.array_join(F.transform(found, lambda f: f["detail"]), ",").alias("details")).where("details <> ''")


@query(f"WITH {_SEEDED}, {_COUNTS} " + _ENCODINGS.format(key="doc_id", html=""))
def encoding_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoding_details(_content(spark, sf_dir), "doc_id")


_PAGES = "seeded AS (SELECT page_id AS doc_id, 'page_' || page_id || {ending} AS path, html AS content, 0.0 AS obf FROM pages)"
_PAGE_END = "CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.txt' END"


@query(
    f"WITH {_PAGES.format(ending=_PAGE_END)}, {_COUNTS}, e AS ("
    + _ENCODINGS.format(key="doc_id", html="AND NOT path LIKE '%.html'")
    + ") SELECT doc_id AS page_id, details FROM e"
)
def page_encoding_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages, every second one named as text, for which entities count."""
    ending = F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".txt")
    rows = _read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page_"), F.col("page_id").cast("string"), ending).alias("path"), F.col("html").alias("content"))
    return _encoding_details(rows, "page_id")


# ---- Decoding --------------------------------------------------------------------------------------------------------


@query(f"WITH {_SEEDED} SELECT doc_id, sha256(content) AS content_sha256, obf::DOUBLE AS obfuscation_score FROM seeded")
def decoded_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("content_sha256"), "obfuscation_score")


_STRIP = "[\u200b\u200c\u200d\ufeff]"


@query(
    f"""WITH t AS (SELECT doc_id, text || {_case(0)} AS text FROM documents)
        SELECT doc_id, sha256(regexp_replace(text, '{_STRIP}', '', 'g')) AS stripped_sha256, regexp_matches(text, '{_STRIP}') AS has_zero_width FROM t"""
)
def zero_width_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldtext.operators.decode import ZERO_WIDTH, zero_width_removed

    text = F.col("text")
    return corpus.seeded(spark, sf_dir).select("doc_id", F.sha2(zero_width_removed(text), 256).alias("stripped_sha256"), text.rlike(ZERO_WIDTH).alias("has_zero_width"))


def _layer_sql() -> str:
    rows = []
    for name, _, _, content, (zero, escapes, entities, blobs) in corpus.LAYER_ROWS:
        score = "0.0" + " + 0.3" * blobs + " + 0.2" * escapes + " + 0.3" * zero + " + 0.2" * entities
        rows.append(f"({quoted(name)}, {quoted(content)}, {zero}, {escapes}, {entities}, {blobs}, round(({score})::DOUBLE, 6))")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(name, content, has_zero_width, has_unicode_escapes, has_html_entities, has_base64, obfuscation_score)"


@query(_layer_sql())
def decode_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode escapes, entities, base64 and their order, on literal rows."""
    rows = [(name, text, "x.html" if html else "x.md") for name, text, html, *_ in corpus.LAYER_ROWS]
    out = decode(spark.createDataFrame(rows, "name string, text string, path string"))
    return out.select("name", "content", "has_zero_width", "has_unicode_escapes", "has_html_entities", "has_base64", F.round("obfuscation_score", 6).alias("obfuscation_score"))


# ---- Signatures ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_PATTERNS}, h AS (SELECT 'line' AS kind, {_salted('norm')} AS hash FROM pats UNION ALL SELECT 'gram', {_salted('g')} FROM grams)
        SELECT kind, hash, count(*) AS n FROM h GROUP BY kind, hash"""
)
def signature_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match.pattern_hashes(corpus.patterns(spark, sf_dir), SALT)
    return rows.groupBy("kind", F.lower(F.hex("hash")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PATTERNS} SELECT {_salted('norm')} AS line_hash, row_number() OVER (ORDER BY {_salted('norm')}) - 1 AS place FROM pats")
def signature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container's table: every pattern's line hash in byte order, repeats kept, after a round trip through the file's form."""
    from veldtext.sources import signatures as S

    found = S.from_bytes(S.to_bytes(_signatures(spark, sf_dir)))
    return spark.createDataFrame([(h.hex(), k) for k, h in enumerate(found.hashes)], "line_hash string, place long")


@query(
    f"""WITH {_PATTERNS}, {_BITS} SELECT 1 AS version, '{SALT.hex()}' AS salt, m AS bits, k AS hashes, 34 + m // 8 + 32 * c AS seal_at,
            34 + m // 8 + 32 * c + 32 AS bytes, TRUE AS sealed, FALSE AS other_key, FALSE AS damaged
        FROM sized, (SELECT count(*) AS c FROM pats)"""
)
def signature_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of the compiled container, its size, and whether its seal holds, with another key, and after damage."""
    from veldtext.sources import signatures as S

    def holds(data: bytes, key: bytes) -> bool:
        try:
            S.verify(data, key)
        except S.SignatureError:
            return False
        return True

    data = S.to_bytes(_signatures(spark, sf_dir), b"key")
    magic, version, salt, bits, hashes, at = S.HEADER.unpack_from(data)
    damaged = data[:-40] + bytes([data[-40] ^ 1]) + data[-39:]
    row = (version, salt.hex(), bits, hashes, at, len(data), magic == S.MAGIC and holds(data, b"key"), holds(data, b"other"), holds(damaged, b"key"))
    return spark.createDataFrame([row], "version int, salt string, bits long, hashes long, seal_at long, bytes long, sealed boolean, other_key boolean, damaged boolean")


_SIZES = ((1000, 0.01), (100, 0.01), (10000, 0.01), (1, 0.01), (0, 0.01), (100, -1.0), (100, 2.0), (298980, 0.001))


@query(
    "WITH t(items, rate) AS (VALUES " + ", ".join(f"({n}, {p}::DOUBLE)" for n, p in _SIZES) + """),
        u AS (SELECT items, rate, greatest(items, 1) AS n, CASE WHEN rate > 0 AND rate < 1 THEN rate ELSE 0.01 END AS p FROM t),
        m AS (SELECT *, (ceil(-n * ln(p) / (ln(2) * ln(2)))::BIGINT + 7) // 8 * 8 AS bits FROM u)
        SELECT items, rate, bits, greatest(ceil(bits / n * ln(2)), 1)::BIGINT AS hashes FROM m"""
)
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, p, *bloom.sizing(n, p)) for n, p in _SIZES], "items long, rate double, bits long, hashes long")


@query(
    f"""WITH {_PATTERNS}, {_BITS}, h AS (SELECT {_salted('norm')} AS d FROM pats UNION SELECT {_salted('g')} FROM grams)
        SELECT DISTINCT {_position('d')} AS bit FROM h, sized, unnest(range(0, k)) AS places(i)"""
)
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the bits that are set in the compiled filter."""
    import numpy as np

    found = _signatures(spark, sf_dir).bloom
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(found.data, np.uint8), bitorder="little"))
    return spark.createDataFrame([(int(b),) for b in bits], "bit long")


@query(
    f"""WITH {_SEEDED}, {_PATTERNS}, {_LINES},
        every AS (SELECT doc_id, {_salted("g")} AS d FROM (
                SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: array_to_string(ws[i : i + n - 1], ' '))) AS g
                FROM (SELECT doc_id, string_split({_norm("content")}, ' ') AS ws FROM seeded), unnest([4, 5, 6]) AS sizes(n)) GROUP BY ALL),
        tested AS (SELECT doc_id, d, {_position("d")} AS bit FROM every, sized, unnest(range(0, k)) AS places(i)),
        passed AS (SELECT doc_id, d FROM tested WHERE bit IN (SELECT bit FROM setbits) GROUP BY ALL HAVING count(*) = (SELECT k FROM sized))
        SELECT path, doc_id IN (SELECT doc_id FROM passed) AS bloom_hit FROM seeded"""
)
def bloom_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-gram gate of every text, whether or not it has a matching line."""
    return match.gated(_content(spark, sf_dir), _signatures(spark, sf_dir), "path")


@query(f"WITH {_SEEDED}, {_PATTERNS}, {_LINES} SELECT doc_id, n AS hash_matches, line AS first_line FROM matches")
def hash_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.hash_matches(_content(spark, sf_dir), _signatures(spark, sf_dir), "doc_id")


@query(f"WITH {_PLAIN}, {_PATTERNS}, {_LINES} SELECT doc_id, n AS hash_matches, line AS first_line FROM matches")
def hash_matches_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the documents as they are."""
    rows = _docs(spark, sf_dir).withColumnRenamed("text", "content")
    return match.hash_matches(rows, _signatures(spark, sf_dir), "doc_id")


# ---- Scan and report -------------------------------------------------------------------------------------------------


@query(f"{_ALL} SELECT path, score, severity, severity_name, findings, line FROM named")
def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_results(spark, sf_dir))


@query(f"WITH {_PLAIN}, {_SENTENCES}, {_PATTERNS}, {_LINES}, {_COUNTS}, {_RATIO}, {_SHIFT}, {_FOUND} SELECT path, score, findings FROM named")
def scan_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are."""
    return _flat(scan(_docs(spark, sf_dir), _signatures(spark, sf_dir), LOW)).select("path", "score", "findings")


@query(f"{_ALL.replace('LEFT JOIN matches m USING (doc_id)', 'LEFT JOIN (SELECT * FROM matches WHERE FALSE) m USING (doc_id)')} SELECT path, findings, score FROM named")
def scan_without_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scan(corpus.seeded(spark, sf_dir), None, LOW)).select("path", "findings", "score")


@query(
    f"""WITH {_SEEDED}, {_SENTENCES}, {_COUNTS}, {_RATIO}, {_SHIFT}, matches AS (SELECT 0 AS doc_id, 0 AS n, 0 AS line WHERE FALSE), {_FOUND}
        SELECT path, round(s1 + s2 + s3 + s4 + s6 + s7, 6) AS total FROM scored"""
)
def analyze_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heuristics alone, summed."""
    return H.analyzed(_content(spark, sf_dir)).select("path", F.round(H.total(F.col("found")), 6).alias("total"))


_SCORES = ((0, 80), (19.9, 80), (20, 80), (49.9, 80), (50, 80), (79.9, 80), (80, 80), (100, 80), (60, 60), (30, 30), (10, 5))


@query(
    "WITH t(score, threshold) AS (VALUES " + ", ".join(f"({s}::DOUBLE, {t}::DOUBLE)" for s, t in _SCORES) + """)
        SELECT score, threshold, CASE WHEN score >= threshold THEN 'BLOCKED' WHEN score >= 50 THEN 'SUSPECT' WHEN score >= 20 THEN 'WARN' ELSE 'CLEAN' END AS severity_name FROM t"""
)
def classify_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(float(s), float(t)) for s, t in _SCORES], "score double, threshold double")
    return rows.withColumn("severity_name", severity_name(classify(F.col("score"), F.col("threshold")).cast("int")))


@query(
    f"""{_ALL} SELECT count(*) AS total_files, count_if(severity = 3) AS blocked, count_if(severity = 2) AS suspect, count_if(severity = 1) AS warn,
        count_if(severity = 0) AS clean, coalesce(bool_or(severity = 3), FALSE) AS any_blocked FROM named"""
)
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_results(spark, sf_dir))


@query(f"{_ALL} SELECT severity, severity_name, count(*) AS files FROM named GROUP BY ALL")
def files_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_severity(_results(spark, sf_dir))


@query(f"{_ALL} SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS place FROM named ORDER BY score DESC, path LIMIT 20")
def top_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The console's order: the twenty highest scores."""
    from pyspark.sql import Window

    top = report.ordered(_flat(_results(spark, sf_dir)).select("path", "score")).limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), report.walk_order())))


@query(f"{_ALL} SELECT path, score, severity_name FROM named WHERE severity >= 2")
def quiet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(report.quiet(_results(spark, sf_dir))).select("path", "score", "severity_name")


@query(
    f"""{_ALL} SELECT path, '  [' || lpad(round_even(score, 0)::INT::VARCHAR, 3, ' ') || '] ' || path || CASE WHEN line > 0 THEN ':' || line ELSE '' END
        || CASE WHEN findings <> '' THEN '        ' || findings ELSE '' END AS text FROM named WHERE severity >= 1"""
)
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).where("severity >= 1").select("path", report.console_line().alias("text"))


@query(
    f"""{_ALL} SELECT path, '{{"path":' || to_json(path) || ',"score":' || score || ',"severity":' || severity
        || CASE WHEN findings <> '' THEN ',"findings":' || to_json(string_split(findings, ' + ')) ELSE '' END
        || CASE WHEN line > 0 THEN ',"line":' || line ELSE '' END || '}}' AS text FROM named"""
)
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result as a line of JSON."""
    rows = _results(spark, sf_dir).withColumn("score", F.round("score", 6))
    return rows.select("path", report.result_json().alias("text"))


@query(f"{_ALL}, twice AS (SELECT path, score FROM named UNION ALL SELECT path, score FROM named) SELECT path, score, count(*) AS n FROM twice GROUP BY ALL")
def multi_path_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same source twice: its files count twice."""
    from veldtext.operators.scan import scan_paths

    rows = corpus.seeded(spark, sf_dir)
    return _flat(scan_paths([rows, rows], _signatures(spark, sf_dir), LOW)).groupBy("path", "score").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"({quoted(p)}, {kept}, {flat})" for p, _, kept, flat in corpus.FILE_ROWS) + ") AS t(path, kept, kept_flat)"
)
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lister of the file source, on a folder of real files."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as root:
        for name, size, *_ in corpus.FILE_ROWS:
            os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
            with open(f"{root}/{name}", "wb") as file:
                file.truncate(size)
        every, flat = ({os.path.relpath(p, root) for p, _ in listed(root, c)} for c in (ScanConfig(), ScanConfig(recursive=False)))
    rows = [(name, name in every, name in flat) for name, *_ in corpus.FILE_ROWS]
    return spark.createDataFrame(rows, "path string, kept boolean, kept_flat boolean")
