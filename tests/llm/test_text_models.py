"""Tokenising, packing, languages, toxicity."""

import base64
import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_tables import prose, table
from tokenizers import Tokenizer

from veldtext.llm import language_id, packing, pretokens, toxicity
from veldtext.llm.byte_bpe import ByteBpe, encode_documents, model_bytes

ODD = [
    "", " ", "  ", "a  b", " a", "a ", "a \n b", "a\n \nb", "a\n\n  b", "don't  stop\t x\x00\x7f", "é è   x", "foo\n bar", "<|endoftext|> x <|endoftext|>",
    " <|endoftext|>", "a  <|endoftext|> b", "<|endoftext|> ", " <|endoftext|>x  ", "\n<|endoftext|><|endoftext|>\n \n", "<|endoftext", "|endoftext|>  <|",
    "a <|endoftext|>b", "x　 y", " \n", "\n ", "日本 語テキ スト", "🙂 🙂🙂  🙂", "'s 's", "a's 's b", "x   y", "x   y", "a" * 5000,
]


def test_bpe_equals_tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = [*ODD, *(prose(k, 300) for k in range(5))]
    got = bpe.encode(texts)
    assert got == [want.encode_ordinary(t) for t in texts]
    assert [bpe.decode(g) for g in got] == [t.encode() for t in texts]


def test_model_is_small_and_whole():
    import sentencepiece

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc"]
    model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
    assert model.get_piece_size() == 260 and model.unk_id() == 259 and model.bos_id() == -1


def test_encoded_documents(spark, odd_pairs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = encode_documents(table(spark, odd_pairs), path, P.PATTERN, with_ids=True).collect()
    assert len(rows) == len(odd_pairs)
    texts = {i: t or "" for i, t in odd_pairs}
    for r in rows:
        assert bytes(r.decoded) == texts[r.doc_id].encode() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


@pytest.mark.parametrize(("name", "most"), [("MOST_CHUNKS", 7), ("MOST_CHARS", 40)])
def test_small_memory(monkeypatch, name, most):
    monkeypatch.setattr(pretokens, name, most)
    bpe = ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in (prose(1, 40), prose(2, 40), prose(1, 40), *ODD):
        assert bpe.decode(bpe.encode([t])[0]) == t.encode() and len(bpe.memo.numbers) <= 60


def test_pieces(spark, odd_pairs):
    path = P.path("byte_bpe_50k.json")
    want, plain = {}, Tokenizer.from_file(path)
    pairs = [p for k, p in enumerate(odd_pairs) if p[0] is not None and p not in odd_pairs[:k]] + [(1000 + k, t) for k, t in enumerate(ODD)]
    for i, t in pairs:
        want[i] = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
    brute.packed(packing.pack_documents(table(spark, pairs), path, P.PATTERN).collect(), want)


def test_ids_with_special_tokens_in_any_place():
    rng = random.Random(8)
    parts = ["<|endoftext|>", " ", "  ", "\n", "a", "the cat", "<|", "endoftext", "|>", "\t", "é", "'s"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(2000)]
    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = packing.JsonTokenizer(path, P.PATTERN).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("name", "most"), [("MOST_CHUNKS", 5), ("MOST_CHARS", 40)])
def test_ids_with_a_small_memory(monkeypatch, name, most):
    monkeypatch.setattr(pretokens, name, most)
    path = P.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), packing.JsonTokenizer(path, P.PATTERN)
    for t in [prose(1, 40), prose(2, 40), prose(1, 40), *ODD, prose(2, 40)]:
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_plain_chunks_go_to_the_model_by_their_runs(monkeypatch):
    """The library's own cutting gets none of them, and the ids are the library's."""
    path = P.path("byte_bpe_50k.json")
    plain, own, others = Tokenizer.from_file(path), packing.JsonTokenizer(path, P.PATTERN), []
    cut = own._encode_any
    monkeypatch.setattr(own, "_encode_any", lambda chunks: others.extend(chunks) or cut(chunks))
    rng = random.Random(4)
    letters = [chr(c) for c in range(33, 592) if chr(c).isalpha() and c not in (170, 181, 186)]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
    parts = [*letters, *marks, *"0123456789", *["\n"] * 20, *[" "] * 200]
    easy = [" ".join("".join(rng.choices(letters + marks + list("0123456789"), k=9)) for _ in range(8)) for _ in range(400)]
    easy += ["".join(letters), "".join(marks), "one.\nTwo, 3rd\n&&& x1y2\n", prose(3, 200)]
    hard = ["".join(rng.choices([*parts, "'", "'s", "\t", "\0", "\u0100", "\u0120", "\u01c5", "ª", "²", "日", "\xa0", "\xad"], k=rng.randint(1, 60))) for _ in range(3000)]
    for texts, whole in ((easy, True), (hard, False)):
        got = own.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert bool(others) != whole


def test_chunks_in_use_stay(monkeypatch):
    """A frequent chunk is encoded once, though it came late and the memory was full many times."""
    monkeypatch.setattr(pretokens, "MOST_CHUNKS", 20)
    asked = []
    memo = pretokens.ChunkIds(lambda chunks: asked.extend(chunks) or [np.array([len(c)], "<u4").tobytes() for c in chunks], P.PATTERN)
    for k in range(40):
        text = " ".join(f"rare{n}" for n in range(10 * k, 10 * k + 10)) + " often" * (3 * (k > 5))
        assert np.frombuffer(memo.ids([text])[0], "<u4").tolist() == [len(c) + (i > 0) for i, c in enumerate(text.split(" "))]
    assert asked.count(" often") == 1 and len(memo.numbers) <= 52


def test_runs_of_one_length(spark, monkeypatch):
    """Lengths with many pieces are numbered in several runs."""
    monkeypatch.setattr(packing, "RUN_PIECES", 7)
    lengths = [5] * 100 + [3] * 50 + [8, 9, 10] + [7] * 6
    pieces = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(pieces, 10).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 10 for b in bins.values())
    assert len(bins) == 50 + 6 + 15 + 3  # two fives; a seven and a three; three threes at a time; the rest


def test_fullest_is_a_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 6)}
        used = packing.fullest(counts, 40)
        top = max(counts)
        sums = {top}
        for length, n in counts.items():
            for _ in range(n - (length == top)):
                sums |= {s + length for s in sums if s + length <= 40}
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_languages(spark):
    german = "der die ßü und äö straße größe über für "
    docs = table(spark, [(k, prose(k, 3000, 80)) for k in range(20)], "en", "a").unionByName(
        table(spark, [(100 + k, german * 300) for k in range(10)], "DE", "b")
    )
    languages, model = language_id.fit(docs)
    assert languages == ["de", "en"]
    rows = spark.createDataFrame(
        [
            (1, None, prose(3, 40, 80), "en", None, "a"), (2, None, german, "en", None, "b"), (3, None, "", "en", None, "a"), (4, None, None, None, None, None),
            (5, None, "12 34 !!", "de", "org", "h"), (6, None, "qqxzvw jkqxz wvxqj " * 40, None, None, None), (6, None, "qqxzvw jkqxz wvxqj " * 40, None, None, None),
        ],
        "doc_id long, page_id long, text string, declared string, suffix string, host string",
    )
    got = {r.doc_id: r for r in language_id.identify(rows, languages, model).collect()}
    assert (got[1].lang, got[1].accepted) == ("en", True) and (got[2].lang, got[2].accepted) == ("de", True)
    assert [got[k].accepted for k in (3, 4, 5, 6)] == [False] * 4 and got[6].lang == "und"


def test_host_prior_decides_short_texts(spark):
    docs = table(spark, [(k, "aaa bbb ccc") for k in range(4)], "en").unionByName(table(spark, [(9, "aaa bbb ccc")] * 4, "fr"))
    languages, model = language_id.fit(docs.limit(8))
    assert languages == ["en", "fr"]
    rows = spark.createDataFrame([(1, None, "aaa", "fr", None, None)], "doc_id long, page_id long, text string, declared string, suffix string, host string")
    assert language_id.identify(rows, languages, model, none_share=1e-9).first().lang == "fr"


def test_language_survivors(spark, odd_pairs):
    docs = table(spark, odd_pairs)
    out = language_id.survivors(docs)
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert not ids & {80, 81, 82} and ids >= set(range(12)) | {20, 60, 90, 93, 97, -5}


def test_page_evidence(spark):
    pages = spark.createDataFrame(
        [(1, "https://M.Example.ORG:80/x", '<html class="q" lang=\'FR-ca\'><script>var x="en"</script><p>Bonjour</p>'), (2, None, None)],
        "page_id long, url string, html string",
    )
    one, two = language_id.page_rows(pages).orderBy("page_id").collect()
    assert (one.declared, one.suffix, one.host, one.text.strip()) == ("fr", "org", "m.example.org", "Bonjour")
    assert (two.declared, two.suffix, two.host, two.text) == (None, None, None, "")


def test_rare_languages_are_kept(spark):
    """More languages than fit in a slice, and than any cap by frequency would leave."""
    names = [f"l{k:02d}" for k in range(70)]
    docs = None
    for k, name in enumerate(names):
        part = table(spark, [(100 * k + i, prose(1000 + k, 300, 12)) for i in range(1 + (k < 66))], name, None)
        docs = part if docs is None else docs.unionByName(part)
    docs = docs.coalesce(2)
    languages, model = language_id.fit(docs)
    assert languages == names and model.shape == (71, language_id.BUCKETS)
    got = language_id.identify(language_id.document_rows(docs), languages, model).collect()
    assert len(got) == 136 and all(r.accepted and r.lang == names[r.doc_id // 100] == r.text_lang for r in got)


def test_no_languages(spark, odd_pairs):
    none = table(spark, odd_pairs).where("false")
    assert language_id.fit(none)[0] == [] and not language_id.survivors(none).collect()
    rows = language_id.document_rows(table(spark, [(1, "x")]))
    assert not language_id.identify(rows, [], np.zeros((1, 8), np.float32)).first().accepted


def test_isotonic():
    x, y = toxicity.isotonic(np.array([3.0, 1, 2, 4]), np.array([0.0, 0, 1, 1]))
    assert np.all(np.diff(y) >= 0) and x.tolist() == [1, 1, 2, 3, 4, 4] and y.tolist() == [0, 0, 0.5, 0.5, 1, 1]


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    margin = toxicity.Trees().fit(x[:1500], y[:1500]).margins(x[1500:])
    assert ((margin > 0) == y[1500:]).mean() > 0.9


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rude = ["stinkfisk", "blockhead", "rotbrain", "slimeface"]
    pairs, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        words = prose(k, 60, 400).split()
        if toxic:
            for n in range(6):
                words.insert(n * 7, rude[(k + n) % 4] + ("er" if n % 2 else ""))
        pairs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    pairs += [(700, None), (701, ""), (702, "x" * 100_000), (703, pairs[0][1]), (703, pairs[0][1]), (None, "x")]
    return table(spark, pairs), spark.createDataFrame([*labels, (0, 1), (None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity_on_rows_held_out(spark, toxic_tables):
    docs, labels = toxic_tables
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert by_id[700].score == by_id[701].score and len({r.score for r in rows if r.doc_id in (0, 703)}) == 1


def test_held_out_labels_are_not_read(spark, toxic_tables):
    from pyspark.sql import functions as F

    docs, labels = toxic_tables
    other = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    few = docs.where("doc_id < 40")
    one, two = ({r.doc_id: r.score for r in toxicity.score(few, toxicity.fit(docs, x)).collect()} for x in (labels, other))
    assert one == two


def test_toxicity_without_labels(spark, toxic_tables):
    docs, labels = toxic_tables
    few = docs.where("doc_id < 5")
    assert {r.score for r in toxicity.toxicity(few, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(few, labels.withColumn("toxic", labels["toxic"] * 0)).collect()} == {0.0}
    assert not toxicity.toxicity(docs.where("false"), labels).collect()
