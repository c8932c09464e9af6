"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over the languages and a class of texts in none of them:

* the text: likelihoods of its words under character-trigram models. The models are counted, for each declared language,
  over all labelled documents, by grouped aggregation into a fixed number of hashed trigrams, with smoothing. Every
  declared language has a model, however rare; the models take 128 KB a language;
* the declared language (a markup attribute or a metadata field): right with probability 1 - `wrong`;
* the address suffix, and the host: priors estimated by grouped aggregation of the languages that the texts alone point
  to, smoothed hierarchically: all rows -> suffix -> host, each level worth `weight` rows of the one above. A row's own
  vote is taken out of its host's counts.

The text's likelihood is tempered by the power `temper`, as neighbouring trigrams are not independent. A row is
rejected if the class of no language wins, or if the winner's probability is below `least`.

Defined results: a null or empty text, or one without letters, gives no evidence by its text and is rejected, as it has
no language to find; a null or unknown declared language, suffix or host gives no evidence of that kind; equal
probabilities go to the language whose name sorts first; repeated rows are rows of their own; with an empty table of
labelled texts there are no languages and every row is rejected; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from veldtext.llm.common import materialize, small, trimmed
from veldtext.llm.pretokens import forget, sliced

#: Hashed trigrams of a model; languages whose counts are held at once; words remembered by a worker, the numbers
#: remembered for them, and their characters (beside those of one call).
BUCKETS, SLICE, MOST_WORDS, MOST_NUMBERS, MOST_CHARS = 1 << 15, 32, 200_000, 20_000_000, 8_000_000
NONE = "und"
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_TAGS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"


def buckets(word: str) -> list[int]:
    """The hashed trigrams of a word with a space on either side."""
    padded = f" {word} "
    return [xxhash.xxh32_intdigest(padded[i : i + 3]) % BUCKETS for i in range(len(padded) - 2)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def trigram_counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (text, lang); each task sends its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums: dict[str, np.ndarray] = {}
        pending: dict[str, Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])
            sums.clear()

        def settle() -> Iterator[pa.RecordBatch]:
            for lang, words in pending.items():
                if lang not in sums and len(sums) >= 2 * SLICE:
                    yield from sent()
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                at = np.fromiter((b for w in words for b in buckets(w)), np.int64)
                n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words)))
                total += np.bincount(at, n, BUCKETS).astype(np.int64)
            pending.clear()

        for batch in small(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pending.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, pending.values())) > MOST_WORDS:
                yield from settle()
        yield from settle()
        yield from sent()

    return rows.mapInArrow(lambda batches: trimmed(run(batches)), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order, and log-probabilities of the trigrams: a row for each language, then one for none."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.lower(F.col(lang_col)).alias("lang")
    )
    names = sorted(r.lang for r in known.select("lang").distinct().collect())
    model = np.full((len(names) + 1, BUCKETS), np.log(1 / BUCKETS), np.float32)
    if not names:
        return names, model
    table = materialize(trigram_counts(known))
    everywhere = np.ones(BUCKETS)
    for r in table.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        everywhere[r.bucket] += r.n
    prior = everywhere / everywhere.sum()
    for k in range(0, len(names), SLICE):
        part = names[k : k + SLICE]
        counts = np.zeros((len(part), BUCKETS))
        at = {name: i for i, name in enumerate(part)}
        for r in table.where(F.col("lang").isin(part)).collect():  # SLICE * BUCKETS rows at most
            counts[at[r.lang], r.bucket] = r.n
        smooth = counts + 0.5 * BUCKETS * prior
        model[k : k + len(part)] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return names, model


def text_likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """rows (with a column text, which goes) and ll, the log-likelihood under each row of the model; null if no letters.

    The model is a constant of the task: (languages + 1) * BUCKETS numbers.
    """
    names = [c for c in rows.columns if c != "text"]
    shipped = rows.sparkSession.sparkContext.broadcast(model.T.copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table, seen, known, chars = shipped.value, {}, np.empty((1024, model_rows), np.float32), 0
        most = min(MOST_WORDS, MOST_NUMBERS // model_rows)
        for batch in small(batches):
            found = []
            for texts in sliced([t or "" for t in batch.column("text").to_pylist()]):
                split = [words_of(t) for t in texts]
                new = set().union(*split).difference(seen)
                if len(seen) + len(new) > most or chars > MOST_CHARS:
                    seen.clear()
                    new, chars = set().union(*split), 0
                chars += sum(map(len, new))
                need = len(seen) + len(new)
                if need > len(known):
                    known = np.concatenate([known, np.empty((max(need, 2 * len(known)) - len(known), model_rows), np.float32)])
                new = list(new)
                if new:
                    parts = [buckets(w) for w in new]
                    starts = np.cumsum([0, *map(len, parts[:-1])])
                    flat = np.fromiter((b for p in parts for b in p), np.int64)
                    known[len(seen) : need] = np.add.reduceat(table[flat], starts, axis=0)
                    seen.update(zip(new, range(len(seen), need), strict=True))
                for ws in split:
                    at = np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))
                    found.append(known[at].sum(axis=0, dtype=np.float64).tolist() if len(ws) else None)
            columns = [batch.column(c) for c in names] + [pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "ll"])

    model_rows = len(model)
    return rows.mapInArrow(lambda batches: trimmed(run(batches)), rows.select(*names).schema.add("ll", ArrayType(DoubleType())))


def _by_language(n_langs: int, counts: Column) -> Column:
    """The counts of all languages in order, of an array of (vote, n)."""

    def of(k: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, x: a + F.when(x["vote"] == k, x["n"]).otherwise(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(n_langs - 1)), of)


def identify(
    rows: DataFrame,
    languages: list[str],
    model: np.ndarray,
    temper: float = 0.25,
    wrong: float = 0.05,
    none_share: float = 0.001,
    weight: float = 20.0,
    least: float = 0.5,
) -> DataFrame:
    """rows (key columns, text, declared, suffix, host) with lang, probability, text_lang and accepted in place of text.

    declared, suffix and host may be null.
    """
    n = len(languages)
    keys = [c for c in rows.columns if c != "text"]
    if not n:
        nothing = F.lit(None).cast("string")
        return rows.select(
            *keys, F.lit(NONE).alias("lang"), F.lit(0.0).alias("probability"), nothing.alias("text_lang"), F.lit(False).alias("accepted")
        )
    scored = text_likelihoods(rows, model)
    best = F.array_position(F.slice("ll", 1, n), F.array_max(F.slice("ll", 1, n))).cast("int") - 1
    scored = scored.withColumn("vote", F.when(F.col("ll").isNotNull(), best))
    scored = scored.withColumn("suffix key", F.coalesce("suffix", F.lit(""))).withColumn("host key", F.coalesce("host", F.lit("")))
    scored = materialize(scored)
    votes = materialize(scored.groupBy("suffix key", "host key", "vote").agg(F.count(F.lit(1)).cast("double").alias("n")))
    total = np.ones(n)
    for r in votes.where("vote is not null").groupBy("vote").agg(F.sum("n").alias("n")).collect():
        total[r.vote] += r.n
    overall = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    salts = 16  # a host with a third of all rows is split among tasks; the small table of hosts is repeated for it
    entries = F.collect_list(F.struct("vote", "n"))
    by_suffix = votes.groupBy("suffix key", "vote").agg(F.sum("n").alias("n")).groupBy("suffix key").agg(entries.alias("suffix_n"))
    hosts = votes.groupBy("suffix key", "host key").agg(entries.alias("host_n")).join(by_suffix, "suffix key").select(
        "suffix key",
        "host key",
        _by_language(n, F.col("host_n")).alias("host_n"),
        _by_language(n, F.col("suffix_n")).alias("suffix_n"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    joined = scored.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")).join(
        hosts, ["suffix key", "host key", "salt"], "left"
    )
    voted = F.when(F.col("vote").isNotNull(), 1.0).otherwise(0.0)
    for level in ("suffix", "host"):
        joined = joined.withColumn(f"{level} sum", F.aggregate(f"{level}_n", F.lit(0.0), lambda a, x: a + x) - voted)
    names = F.array(*[F.lit(x) for x in [*languages, NONE]])
    place = F.array_position(F.slice(names, 1, n), F.lower("declared")).cast("int") - 1
    joined = joined.withColumn("said", F.when(place >= 0, place))
    said = F.col("said").isNotNull()

    def evidence(k: Column) -> Column:
        own = F.when(F.col("vote") == k, 1.0).otherwise(0.0)
        p_suffix = (F.get("suffix_n", k) - own + weight * F.get(overall, k)) / (F.col("suffix sum") + weight)
        p_suffix = F.when(F.col("suffix").isNull(), F.get(overall, k)).otherwise(p_suffix)
        p_host = (F.get("host_n", k) - own + weight * p_suffix) / (F.col("host sum") + weight)
        p_host = F.when(F.col("host").isNull(), p_suffix).otherwise(p_host)
        claim = F.when(F.col("said") == k, float(np.log(1 - wrong))).when(said, float(np.log(wrong / max(1, n - 1)))).otherwise(0.0)
        return F.log(p_host * (1 - none_share)) + claim + F.coalesce(F.get("ll", k), F.lit(0.0)) * temper

    none = float(np.log(none_share)) + F.when(said, float(np.log(1 / n))).otherwise(0.0)
    none = none + F.coalesce(F.get("ll", F.lit(n)), F.lit(0.0)) * temper
    logs = F.concat(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), evidence), F.array(none))
    out = joined.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    out = out.withColumn("probability", 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    out = out.withColumn("lang", F.get(names, F.array_position("logs", F.col("top")).cast("int") - 1))
    return out.select(
        *keys,
        F.when(F.col("ll").isNull(), NONE).otherwise(F.col("lang")).alias("lang"),
        "probability",
        F.get(names, F.col("vote")).alias("text_lang"),
        (F.col("ll").isNotNull() & (F.col("lang") != NONE) & (F.col("probability") >= least)).alias("accepted"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of documents: the metadata's language is the declared one, the source is the host."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text",
        F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: the markup's lang attribute, the address suffix and the host."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    html = F.coalesce("html", F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    rows = pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(html, _TAGS, " ").alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"),
    )
    suffix = F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit(""))
    return rows.select("doc_id", "page_id", "text", "declared", suffix.alias("suffix"), "host")


def language_evidence(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """All documents and all pages, with models counted over the documents: a row has a doc_id or a page_id."""
    languages, model = fit(docs)
    return identify(document_rows(docs).unionByName(page_rows(pages)), languages, model)


def survivors(docs: DataFrame) -> DataFrame:
    """The documents whose language is found. A document's row is told apart by its id and its text."""
    languages, model = fit(docs)
    own, text = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    rows = document_rows(docs).withColumn("text key", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = identify(rows, languages, model).where("accepted").select(F.col("doc_id").alias("kept_id"), F.col("text key").alias("kept_text")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("whole"), own.alias("own_id"), text.alias("own_text"))
    match = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_text") == F.col("kept_text"))
    return keyed.join(kept, match, "left_semi").select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
