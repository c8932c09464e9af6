"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon, its hits near second-person words, capitals, punctuation and obfuscation
rates. The lexicon is learned: the words and word beginnings whose share of toxic rows is far above the whole, by the
likelihood-ratio statistic, counted over the labelled training rows by grouped aggregation. So that trees do not trust
terms that only memorise their own rows, the training rows form two folds, and each fold's features use the lexicon of
the other; isotonic regression is fitted to margins of trees grown on the other fold. Whole texts are scored with the
lexicon and the trees of all training rows.

The model is fitted on a bounded sample: the MAX_ROWS labelled rows of smallest hashed id among those whose id is not
held out. Labels, lang, source and ids are never inputs of a score.

Defined results: a null or empty text has all features 0 and gets the score of such texts; a null id counts as the
empty string where held_out is decided; labels repeated for an id count once, the largest holding; without both
classes among the training rows every score is their share of toxic rows (0 if there are none); repeated rows get equal
scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldtext.llm.common import materialize, small, trimmed
from veldtext.llm.pretokens import forget, sliced

#: Labelled rows of a fit, at most; least statistic and support of a term. The rows bound the lexicon: it has no more
#: terms than they have words and word beginnings.
MAX_ROWS, LEAST_G, LEAST_ROWS = 20_000, 20.0, 3
#: Characters of the word beginnings that are terms beside the whole words.
BEGINNINGS = (4, 5, 6)
#: Tokens that a worker remembers, and their characters, at most (beside those of one call).
MOST_TOKENS, MOST_CHARS = 400_000, 8_000_000
#: Second-person words of the four languages of the tables.
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tuyo tus usted ustedes vosotros".split()
)
#: Look-alikes that are read as letters.
ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGE = regex.compile(r"^[\W_]+|[\W_]+$")
_REPEAT = regex.compile(r"(\p{L})\1\1")
NAMES = (
    "hits_share", "weight_share", "weight_sum", "weight_max", "words_hit", "begins_hit", "read_hit", "near_second",
    "near_share", "second_share", "upper_share", "caps_share", "exclaims", "questions", "marks", "mixed_share",
    "repeat_share", "single_share", "log_words",
)


def bare(token: str) -> str:
    """The token in lower case without what is neither letter nor number at its ends."""
    word = token.lower().strip(punctuation)
    return word if word.isalpha() else _EDGE.sub("", word)


def terms_of(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    return ["=" + word, *[word[:n] for n in BEGINNINGS if len(word) >= n]]


class Features:
    """Dense features of texts under one lexicon {term: weight}. A token's part in them is remembered."""

    WIDTH = 13

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.seen, self.table, self.chars = lexicon, {}, np.zeros((1024, self.WIDTH), np.float32), 0

    def _token(self, token: str) -> list[float]:
        word, get = bare(token), self.lexicon.get
        whole = get("=" + word, 0.0)
        begin = max(get(word[:4], 0.0), get(word[:5], 0.0), get(word[:6], 0.0)) if len(word) >= BEGINNINGS[0] else 0.0
        thrice = float(len(word) - len(set(word)) > 1 and bool(_REPEAT.search(word)))
        if word.isalpha():  # nothing is mixed in: only the ends and the capitals are left to count
            upper = 0 if token.islower() else sum(map(str.isupper, token))
            marks = 0 if len(token) == len(word) else sum(not c.isalnum() for c in token)
            return [
                max(whole, begin), float(whole > 0), float(begin > 0), 0.0, float(word in SECOND), upper, float(upper > 1 and upper == len(word)),
                token.count("!") if marks else 0, token.count("?") if marks else 0, marks, 0.0, thrice, float(len(word) == 1),
            ]
        lexicon = self.lexicon
        letters = sum(c.isalpha() for c in word)
        mixed = float(0 < letters < len(word))
        read = 0.0
        if mixed:
            plain = "".join(c for c in token.lower().translate(ALIKE) if c.isalpha())
            read = lexicon.get("=" + plain, 0.0)
        upper = sum(c.isupper() for c in token)
        marks = sum(not c.isalnum() for c in token)
        weight = max(whole, begin, read)
        return [
            weight, float(whole > 0), float(begin > 0), float(read > 0), float(word in SECOND), upper, float(upper > 1 and upper == letters),
            token.count("!"), token.count("?"), marks, mixed, thrice, float(len(word) == 1),
        ]

    def rows(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.seen)
        if len(self.seen) + len(new) > MOST_TOKENS or self.chars > MOST_CHARS:
            self.seen, self.chars = {}, 0
            new = set().union(*split)
        self.chars += sum(map(len, new))
        need = len(self.seen) + len(new)
        if need > len(self.table):
            more = np.zeros((max(need, 2 * len(self.table)), self.WIDTH), np.float32)
            more[: len(self.table)] = self.table
            self.table = more
        new = list(new)
        if new:
            self.table[len(self.seen) : need] = [self._token(t) for t in new]
            self.seen.update(zip(new, range(len(self.seen), need), strict=True))
        out = np.zeros((len(texts), len(NAMES)))
        for k, tokens in enumerate(split):
            if not tokens:
                continue
            part = self.table[np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))]
            total, n = part.sum(axis=0, dtype=np.float64), len(tokens)
            chars = max(1, len(texts[k]))
            hit, near = part[:, 0] > 0, 0
            if total[4] and hit.any():
                sums = np.cumsum(np.r_[0, part[:, 4]])
                at = np.flatnonzero(hit)
                near = int((sums[np.minimum(at + 4, n)] > sums[np.maximum(at - 3, 0)]).sum())
            hits = int(hit.sum())
            out[k] = [
                hits / n, total[0] / n, total[0], part[:, 0].max(), total[1], total[2], total[3], near, near / n, total[4] / n,
                total[5] / chars, total[6] / n, total[7] / n, total[8] / n, total[9] / chars, total[10] / n, total[11] / n, total[12] / n,
                math.log1p(n),
            ]
        return out


class Trees:
    """Gradient-boosted regression trees on the logistic loss, grown over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = math.log(share / (1 - share))
        margin, self.grown = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, curve = p - y, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                best = self._splits(binned, node, gradient, curve, 1 << level)
                feature = np.array([b[0] for b in best])
                cut = np.array([b[1] for b in best])
                splits.append((feature, np.array([edges[f][c] if c < len(edges[f]) else np.inf for f, c in best])))
                node = node * 2 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            size = 1 << self.depth
            leaf = -self.rate * np.bincount(node, gradient, size) / (np.bincount(node, curve, size) + self.ridge)
            margin = margin + leaf[node]
            self.grown.append((splits, leaf))
        return self

    def _splits(self, binned: np.ndarray, node: np.ndarray, gradient: np.ndarray, curve: np.ndarray, nodes: int) -> list[tuple[int, int]]:
        best = [(0, self.bins)] * nodes
        gain = np.full(nodes, 1e-9)
        for f in range(binned.shape[1]):
            at = node * self.bins + binned[:, f]
            g = np.bincount(at, gradient, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
            h = np.bincount(at, curve, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
            whole_g, whole_h = g[:, -1:], h[:, -1:]
            score = g**2 / (h + self.ridge) + (whole_g - g) ** 2 / (whole_h - h + self.ridge) - whole_g**2 / (whole_h + self.ridge)
            score[(h < 1.0) | (whole_h - h < 1.0)] = 0
            top = score.argmax(axis=1)
            for k in np.flatnonzero(score[np.arange(nodes), top] > gain).tolist():
                best[k], gain[k] = (f, int(top[k])), score[k, top[k]]
        return best

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        at = np.arange(len(x))
        for splits, leaf in self.grown:
            node = np.zeros(len(x), np.int64)
            for feature, value in splits:
                node = node * 2 + (x[at, feature[node]] > value[node])
            out += leaf[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to y, by pooling adjacent violators: its knots and values."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum, count, first and last margin
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1, m, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + c, pools[-1][2], last]
    knots = np.array([k for p in pools for k in (p[2], p[3])])
    return knots, np.repeat([p[0] / p[1] for p in pools], 2)


def remainder(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def _lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Lexicons of fold 0, of fold 1 and of both; rows: text, toxic, fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = Counter()
        for batch in small(batches):
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {bare(t) for t in set((text or "").split())} - {""}
                own = {t for w in words for t in terms_of(w)}
                counts.update((t, fold, toxic) for t in own)
            if len(counts) > 2_000_000:
                yield flushed(counts)
        yield flushed(counts)

    def flushed(counts: Counter) -> pa.RecordBatch:
        term, fold, toxic = zip(*counts, strict=True) if counts else ((), (), ())
        columns = [pa.array(term, pa.string()), pa.array(fold, pa.int32()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, names=["term", "fold", "toxic", "n"])

    sizes = {(r.fold, r.toxic): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    counted = rows.select("text", "toxic", "fold").mapInArrow(run, "term string, fold int, toxic int, n long").groupBy("term").agg(
        *[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}{t}") for f in (0, 1) for t in (0, 1)]
    )
    counted = materialize(counted.where(f"n01 + n11 >= {LEAST_ROWS}"))
    out = []
    for folds in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(sizes.get((f, t), 0) for f in folds) for t in (1, 0))
        if not toxic or not clean:
            out.append({})
            continue
        a = sum((F.col(f"n{f}1") for f in folds), F.lit(0)).cast("double")
        b = sum((F.col(f"n{f}0") for f in folds), F.lit(0)).cast("double")
        share = toxic / (toxic + clean)
        g = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
        found = (
            counted.where(a >= LEAST_ROWS).where(a > (a + b) * share)
            .select("term", g.alias("g"), (F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))).alias("weight"))
            .where(F.col("g") >= LEAST_G)
        )
        out.append({r.term: r.weight for r in found.collect()})
    return out


class Scorer:
    """A fitted model: lexicon, trees and calibration; or a constant where there is nothing to fit."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, knots: np.ndarray, values: np.ndarray, constant: float):
        self.lexicon, self.trees, self.knots, self.values, self.constant = lexicon, trees, knots, values, constant

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.constant)
        margin = self.trees.margins(features)
        # The step function is flat between its knots; a thousandth of the logistic of the margin orders its ties.
        return 0.999 * np.interp(margin, self.knots, self.values) + 0.001 / (1 + np.exp(-margin))


def _feature_rows(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """Features of the training rows, each fold under the other's lexicon (fold and toxic stay)."""
    shipped = rows.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = [Features(lexicon) for lexicon in shipped.value]
        for batch in small(batches):
            text, toxic, fold = (c.to_pylist() for c in batch.columns)
            found = [own[1 - f].rows([t or ""])[0].tolist() for t, f in zip(text, fold, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "fold"])

    return rows.select("text", "toxic", "fold").mapInArrow(run, "x array<double>, toxic int, fold int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Scorer:
    """A scorer from labels (doc_id, toxic) of the rows that are not held out."""
    own = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic is not null")
        .where(remainder(F.col("id")) != 1)
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
        .withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int"))
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialize(texts.join(F.broadcast(own), "id"))  # at most max_rows small rows on one side, and texts in all
    lexicons = _lexicons(rows)
    found = _feature_rows(rows, lexicons).collect()  # a short vector for each of at most max_rows labels
    none = np.empty(0)
    if not found:
        return Scorer({}, None, none, none, 0.0)
    x, y, fold = np.array([r.x for r in found]), np.array([r.toxic for r in found], float), np.array([r.fold for r in found])
    order = np.lexsort([*x.T, y, fold])  # the rows' order must not matter
    x, y, fold = x[order], y[order], fold[order]
    if not 0 < y.sum() < len(y):
        return Scorer({}, None, none, none, float(y.mean()))
    margin = np.zeros(len(y))
    for f in (0, 1):
        here = fold == f
        if here.any():
            others = ~here if 0 < y[~here].sum() < (~here).sum() else np.ones(len(y), bool)
            margin[here] = Trees().fit(x[others], y[others]).margins(x[here])
    return Scorer(lexicons[2], Trees().fit(x, y), *isotonic(margin, y), float(y.mean()))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = shipped.value
        features = Features(model.lexicon)
        for batch in small(batches):
            found = [model.scores(features.rows(texts)) for texts in sliced([t or "" for t in batch.column(2).to_pylist()])]
            scores = np.concatenate(found) if found else np.empty(0)
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= least).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(F.col(id_col)) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
