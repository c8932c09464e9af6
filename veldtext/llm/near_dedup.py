"""MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct 5-word shingles. Its signature holds CHUNKS x WIDTH symbols of b = 16 bits, each cut
from the minimum of one hash function over the set. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1
symbols agree, by the pigeonhole principle, up to ERRORS symbols in at least one chunk; with one error allowed, the
errors are enumerated by leaving out each symbol of a chunk in turn, which gives CHUNKS * WIDTH keys a document. So all
pairs within that signature distance (19 of 50 symbols) share a key, and each of them is confirmed; nearly all pairs
beyond it share one, too: two sets with similarity 0.75 share none with probability 4.4e-5. Pairs that meet beyond the
distance are confirmed if a longer signature has them near: of such pairs with similarity 0.75, a part of 2e-5 is not.

Links are confirmed on the full sets. Equal sets are folded first. In hub rounds every document is then checked against
one member of the buckets that it is in, the one that it shares most buckets with, which joins most of a large group of
copies by one link each. After that, all pairs that share a bucket and are still in different components are screened by
their signatures, in blocks of bounded size, each pair in the first bucket that it shares. What passes is not a list of
pairs but of documents and components: such a document is confirmed against the members of the component in place, so
that a group's pairs are looked at and never written down, and no link between components is lost.

The shingles are compared as 64-bit hashes; equal sets are recognised by 128 bits.

Defined results: null and empty texts have an empty set and link with nothing; a text of fewer than five words is one
shingle; rows that repeat an id are one document: each row links by its own set, and all rows of the id, as they have
the id in common, share a component (those with an empty set as well); a row without an id is a document told apart by its text, which links like any
other and gives way to a document with an id; in a component of such documents only, component_id is null and the one
with the least text hash is kept, with all its rows; an empty table gives an empty result; other columns are ignored.

Rows are told apart by a 64-bit hash of their text while they are linked, so that ids play no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldtext.llm.common import materialize, scratch, small
from veldtext.llm.pretokens import held, sliced

CHUNKS, WIDTH, ERRORS = 10, 5, 1
SYMBOLS = CHUNKS * WIDTH
#: Symbols that two signatures may differ in so that they share a key for certain.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Symbols of the longer signature, whose first SYMBOLS make the keys. Pairs beyond DISTANCE that meet nevertheless are
#: confirmed if they differ in no more than MOST_DIFFERENT of them.
SCREEN, MOST_DIFFERENT = 128, 52
#: Rows of a block when the rest of a bucket is screened; members and guests of a block when a component is confirmed.
BLOCK, MEMBERS, GUESTS = 2048, 512, 2048
#: Numbers of documents that are broadcast, at most: 8 bytes each, some 40 in a table.
MOST_BROADCAST = 1_000_000
#: Words that a worker remembers, and their bytes, at most (beside those of one call).
MOST_WORDS, MOST_BYTES = 400_000, 8_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"%d" % i, seed) | 1 for i in range(n)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets, signatures, sketches and keys of texts. Word hashes are remembered."""

    def __init__(self, words: int = 5):
        self.words, self.known, self.size = words, {}, 0
        self.places = _odd(1, words)
        self.functions = _odd(2, SCREEN)
        self.factors = _odd(3, SYMBOLS).reshape(CHUNKS, WIDTH)
        self.left_out = _odd(4, SYMBOLS).reshape(CHUNKS, WIDTH)

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MOST_WORDS or self.size > MOST_BYTES:
            known.clear()
            self.size = 0
        new = set(words).difference(known)
        self.size += sum(map(len, new))
        for w in new:
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        split = [t.encode().translate(_LOWER).split() for t in texts]
        hashes = self._word_hashes([w for ws in split for w in ws])
        out, at = [], 0
        for ws in split:
            own, at = hashes[at : at + len(ws)], at + len(ws)
            n = max(1, len(own) - self.words + 1) if len(own) else 0
            total = np.zeros(n, np.uint64)
            for i, place in enumerate(self.places[: len(own)]):
                total += _mix(own[i : i + n] + place) * place
            out.append(np.unique(_mix(total + np.uint64(min(len(own), self.words)))))
        return out

    def summary(self, own: np.ndarray) -> tuple[list[int], int, int, bytes]:
        """Keys, the two halves of the set's identity, and the signature."""
        least = np.full(SCREEN, 2**64 - 1, np.uint64)
        for k in range(0, len(own), 2048):
            least = np.minimum(least, (own[k : k + 2048, None] * self.functions).min(axis=0))
        symbols = (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
        # Each symbol of a chunk is a term; a key is the sum of a chunk's terms without one of them.
        terms = _mix((symbols[:SYMBOLS].reshape(CHUNKS, WIDTH) + np.uint64(1)) * self.factors)
        keys = _mix(terms.sum(axis=1, dtype=np.uint64)[:, None] - terms + self.left_out)
        halves = np.array([own.sum(dtype=np.uint64) + np.uint64(len(own)), _mix(own).sum(dtype=np.uint64)], np.uint64)
        return keys.reshape(-1).view(np.int64).tolist(), *halves.view(np.int64).tolist(), symbols.tobytes()


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _wanted(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """The text of each of the nodes (doc_id). Up to MOST_BROADCAST nodes go to the texts, and not the texts to them."""
    nodes = materialize(nodes.distinct())
    if nodes.count() <= MOST_BROADCAST:
        nodes = F.broadcast(nodes)
    texts = docs.select(_node(F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per document: doc_id, node, n (size of its set), h1 and h2 (identity of the set), sig, keys; null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = held(Shingler, words)
        for batch in small(batches):
            at = 0
            for texts in sliced([t or "" for t in batch.column(1).to_pylist()]):
                sets = shingler.sets(texts)
                rows = [shingler.summary(own) if len(own) else (None,) * 4 for own in sets]
                keys, h1, h2, sig = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        batch.column(2).slice(at, len(texts)),
                        pa.array([len(own) for own in sets], pa.int64()),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                        pa.array(sig, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "node", "n", "h1", "h2", "sig", "keys"],
                )
                at += len(texts)

    schema = "doc_id long, node long, n long, h1 long, h2 long, sig binary, keys array<long>"
    return _texts(docs, id_col, text_col).withColumn("node", _node(F.col("text"))).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per document: doc_id and its sorted distinct shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = held(Shingler, words)
        for batch in small(batches):
            at = 0
            for texts in sliced([t or "" for t in batch.column(1).to_pylist()]):
                sets = [own.tobytes() for own in shingler.sets(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(sets, pa.binary())], names=["doc_id", "own"]
                )
                at += len(texts)

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, own binary")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two signatures (rows of symbols) are near enough to be confirmed."""
    apart = a != b
    return (apart[..., :SYMBOLS].sum(axis=-1) <= DISTANCE) | (apart.sum(axis=-1) <= MOST_DIFFERENT)


def _likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the longer signatures are near: most such pairs have the similarity."""
    return (a != b).sum(axis=-1) <= MOST_DIFFERENT


def _screened(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b) of a document and its hub, those that are likely to have the similarity. What goes here is not
    lost: it still meets in its buckets."""
    one = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    rows = pairs.join(one, "a").join(two, "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SCREEN) for c in (2, 3)]
            near = pa.array(_likely(*sigs))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return rows.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = materialize(shingle_sets(_wanted(docs, text_col, wanted), words=words))
    one = sets.select(F.col("doc_id").alias("a"), F.col("own").alias("own_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("own").alias("own_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "own_a", "own_b")
    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the smallest node that can be reached.

    Each round hooks every root to the smallest neighbouring root and then halves the paths until they are flat; the
    number of rounds grows with the logarithm of a component's size.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    left = edges
    while not left.isEmpty():
        hooks = left.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up")).groupBy("node").agg(F.min("up").alias("up"))
        flat = flattened(hooks.select("node", F.col("up").alias("root")))
        to = flat.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = materialize(roots.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        for end in ("a", "b"):
            left = left.join(to.select(F.col("root").alias(end), "top"), end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
        left = materialize(left.where("a <> b").select("a", "b").distinct())
    return roots


def flattened(parents: DataFrame) -> DataFrame:
    """parents (node, root) with root < node: every node with the end of its path."""
    parents = materialize(parents)
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
        parents = materialize(
            parents.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        )
        if parents.where("moved").isEmpty():
            return parents.drop("moved")
        parents = parents.drop("moved")


def _relabelled(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots (doc_id, comp) after the links found (a, b)."""
    ends = found
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("doc_id").alias(end), F.col("comp").alias(f"comp_{end}")), end)
    joined = components(ends.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    joined = joined.select(F.col("node").alias("comp"), "root")
    return materialize(roots.join(joined, "comp", "left").select("doc_id", F.coalesce("root", "comp").alias("comp")))


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the buckets that still hold more than one component, with their component."""
    rows = buckets.join(roots, "doc_id")
    keys = materialize(
        rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    )
    return materialize(rows.join(keys, "key", "left_semi").select("key", "at", "doc_id", "comp"))


def _hub_pairs(rows: DataFrame, rank: Column) -> DataFrame:
    """One pair for each document: it and the hub that it shares most buckets with, of another component.

    A bucket's hub is its member of smallest rank; rows: key, doc_id, comp.
    """
    hubs = materialize(rows.groupBy("key").agg(F.min(F.struct(rank, "doc_id", "comp")).alias("hub")).select("key", "hub.doc_id", "hub.comp"))
    hubs = hubs.select("key", F.col("doc_id").alias("hub"), F.col("comp").alias("hub_comp"))
    votes = rows.join(hubs, "key").where("comp <> hub_comp").groupBy("doc_id", "hub").count()
    return votes.groupBy("doc_id").agg(F.max(F.struct("count", -F.col("hub"))).alias("best")).select(
        F.col("doc_id").alias("a"), (-F.col("best.col2")).alias("b")
    )


def _meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first key that each pair of signatures shares, or -1: of a chunk that agrees, the key that
    leaves out its first symbol; of one with an error, the key that leaves out that."""
    apart = (a[:, :SYMBOLS] != b[:, :SYMBOLS]).reshape(-1, CHUNKS, WIDTH)
    errors = apart.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    row = np.arange(len(a))
    return np.where(errors[row, chunk] <= 1, chunk * WIDTH + apart[row, chunk].argmax(axis=1), -1)


def _groups(batches: Iterator[pa.RecordBatch], columns: list, work) -> Iterator[pa.RecordBatch]:
    """work(one array for each column) for each run of equal first columns of sorted batches."""
    rest = None

    def parts(cols: list, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            out = work([c[x:y] for c in cols[1:]])
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [read(batch.column(i)) for i, read in enumerate(columns)]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]).tolist()
        yield from parts(cols, starts)
        rest = [c[starts[-1] :] for c in cols]
    if rest is not None:
        yield from parts(rest, [0, len(rest[0])])


def _plain(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SCREEN)


def _objects(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _rest(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): a document and another component with a member that shares a bucket with it and passes the screen.

    In each bucket the rows outside its largest component meet all rows, in blocks of BLOCK by BLOCK rows; rows: key, at
    (number of the key), doc_id, comp.
    """
    sizes = rows.groupBy("key", "comp").count()
    most = sizes.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("all"))
    most = materialize(
        most.select(
            "key",
            F.col("top.comp").alias("main"),
            F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("top.count")) / BLOCK).cast("int").alias("few_blocks"),
        )
    )
    full = rows.join(most, "key").join(reps.select("doc_id", "n", "sig"), "doc_id")
    own = F.xxhash64("doc_id")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    few_every = F.sequence(F.lit(0), F.col("few_blocks") - 1)
    facts = ["doc_id", "comp", "n", "sig", "main", "at"]
    few = full.where("comp <> main").select(
        "key", F.pmod(own, F.col("few_blocks")).cast("int").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"), *facts
    )
    many = full.select("key", F.explode(few_every).alias("i"), F.pmod(own, F.col("blocks")).cast("int").alias("j"), F.lit(1).alias("side"), *facts)
    blocks = few.unionByName(many).select(
        F.xxhash64("key", "i", "j").alias("block"), "side", "doc_id", "comp", "n", (F.col("comp") == F.col("main")).alias("in_main"), "at", "sig"
    )
    blocks = blocks.repartition("block").sortWithinPartitions("block", "side")

    def screen(part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        side, doc, comp, n, main, at, sig = part
        cut = int(np.searchsorted(side, 1))
        found = []
        for k in range(0, cut, 64):
            x = slice(k, min(k + 64, cut))
            ok = (comp[x, None] != comp[None, cut:]) & (main[cut:] | (doc[x, None] < doc[None, cut:]))
            low, high = np.minimum(n[x, None], n[None, cut:]), np.maximum(n[x, None], n[None, cut:])
            p, q = np.nonzero(ok & (4 * low >= 3 * high))
            for step in range(0, len(p), 8192):
                u, v = p[step : step + 8192] + k, q[step : step + 8192] + cut
                near = _near(sig[u], sig[v])
                u, v = u[near], v[near]
                here = _meeting(sig[u], sig[v]) == at[0]
                if here.any():
                    found.append(np.unique(np.stack([doc[u[here]], comp[v[here]]], axis=1), axis=0))
        if not found:
            return None
        found = np.unique(np.concatenate(found), axis=0)
        return found[:, 0], found[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _groups(batches, [_plain] * 7 + [_symbols], screen)

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _joined(meets: DataFrame, roots: DataFrame, docs: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """Of (a, b) as :func:`_rest` gives them, those where a member of b has the similarity to a."""
    comps = materialize(
        roots.join(meets.select(F.col("b").alias("comp")).distinct(), "comp", "left_semi")
    )
    members = comps.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    guests = meets.groupBy(F.col("b").alias("comp")).agg(F.ceil(F.count(F.lit(1)) / GUESTS).cast("int").alias("guest_blocks"))
    counts = materialize(members.join(guests, "comp"))
    wanted = meets.select(F.col("a").alias("doc_id")).unionByName(comps.select("doc_id"))
    sets = materialize(shingle_sets(_wanted(docs, text_col, wanted), words=words))
    own = F.xxhash64("doc_id")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    guest_every = F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1))
    members = comps.join(counts, "comp").select("comp", F.pmod(own, F.col("blocks")).cast("int").alias("i"), guest_every.alias("j"), F.lit(0).alias("side"), "doc_id")
    guests = meets.select(F.col("a").alias("doc_id"), F.col("b").alias("comp")).join(counts, "comp")
    guests = guests.select("comp", every.alias("i"), F.pmod(own, F.col("guest_blocks")).cast("int").alias("j"), F.lit(1).alias("side"), "doc_id")
    blocks = members.unionByName(guests).join(sets, "doc_id")
    blocks = blocks.select(F.xxhash64("comp", "i", "j").alias("block"), "side", "doc_id", "comp", "own")
    blocks = blocks.repartition("block").sortWithinPartitions("block", "side")

    def confirm(part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        side, doc, comp, own = part
        cut = int(np.searchsorted(side, 1))
        if not cut:
            return None
        flat = np.frombuffer(b"".join(own[:cut].tolist()), np.uint64)
        sizes = np.array([len(o) // 8 for o in own[:cut]])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        found = []
        for guest, mine in zip(doc[cut:].tolist(), own[cut:].tolist(), strict=True):
            mine = np.frombuffer(mine, np.uint64)
            common = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat, starts, dtype=np.int64)
            if (100 * common >= percent * (sizes + len(mine) - common)).any():
                found.append(guest)
        return (np.array(found, np.int64), np.full(len(found), comp[0], np.int64)) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _groups(batches, [_plain] * 4 + [_objects], confirm)

    return blocks.mapInArrow(run, "a long, b long")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, hub_rounds: int = 3
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    found = _linked(docs, id_col, text_col, words, percent, hub_rounds)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, hub_rounds: int = 3) -> DataFrame:
    """What :func:`near_components` returns, and the node of each row. While nodes are linked, they are named doc_id."""
    with scratch() as keep:
        every = keep(materialize(signatures(docs, id_col, text_col, words)))
        real = every.where("n > 0")
        same = materialize(real.groupBy("h1", "h2", "n").agg(F.min("node").alias("rep"), F.min("doc_id").alias("least_id")))
        own = real.select(F.col("node").alias("doc_id"), "n", "h1", "h2", "sig", "keys")
        reps = materialize(own.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
        roots = _near_roots(reps, docs, text_col, words, percent, hub_rounds)
        root_of = roots.select(F.col("doc_id").alias("rep"), "comp")
        classes = materialize(same.join(root_of, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
        classes, of_id = _joined_by_id(every, classes)
        named = classes.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.min("rep").alias("least_node"))
        classes = keep(materialize(classes.join(named, "comp").select("h1", "h2", "n", "component_id", "least_node", "comp")))
        if of_id is not None:
            names = classes.groupBy("comp").agg(F.min("component_id").alias("id_component"))
            of_id = keep(materialize(of_id.join(names, "comp").select("doc_id", "id_component")))
    out = every.select("doc_id", "node", "n", "h1", "h2").join(classes.drop("comp"), ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    if of_id is not None:
        out = out.join(of_id, "doc_id", "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.coalesce("id_component", "doc_id"))
    alone = component.isNull() & ((F.col("n") == 0) | (F.col("node") == F.col("least_node")))
    return out.select(
        "doc_id", "node", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.when(F.col("doc_id").isNull(), alone).otherwise(F.col("doc_id") == component).alias("kept"),
    )


def _near_roots(reps: DataFrame, docs: DataFrame, text_col: str, words: int, percent: int, hub_rounds: int) -> DataFrame:
    """(doc_id, comp) of the representatives that share a key with another."""
    keyed = reps.select("doc_id", F.posexplode("keys").alias("at", "key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"))
    buckets = materialize(keyed.join(shared, "key", "left_semi"))
    roots = materialize(buckets.select("doc_id").distinct().withColumn("comp", F.col("doc_id")))
    rows = buckets.withColumn("comp", F.col("doc_id"))
    for k in range(hub_rounds):
        rank = F.lit(0) if k == 0 else F.xxhash64("key", "doc_id", F.lit(k))
        pairs = materialize(_screened(_hub_pairs(rows, rank), reps))
        found = materialize(_confirmed(pairs, docs, text_col, words, percent))
        n_pairs, n_found = pairs.count(), found.count()
        if n_found:
            roots = _relabelled(roots, found)
        rows = _mixed(buckets, roots)
        if 4 * n_found < n_pairs or not n_pairs:
            break  # what is left finds no hub any more
    meets = materialize(_rest(rows, reps))
    if not meets.isEmpty():
        found = materialize(_joined(meets, roots, docs, text_col, words, percent))
        if not found.isEmpty():
            roots = _relabelled(roots, found)
    return roots


def _joined_by_id(every: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """classes with the components united that have an id in common; and (doc_id, comp) of the ids with rows of several
    sets, None if there are none."""
    identity = F.struct("h1", "h2", "n")
    ids = every.where("doc_id is not null").groupBy("doc_id").agg(F.min(identity).alias("low"), F.max(identity).alias("high"))
    several = materialize(ids.where(~F.col("low").eqNullSafe(F.col("high"))).select("doc_id"))
    if several.isEmpty():
        return classes, None
    own = every.where("n > 0").join(several, "doc_id", "left_semi").select("doc_id", "h1", "h2", "n")
    own = materialize(own.join(classes.select("h1", "h2", "n", "comp"), ["h1", "h2", "n"]).select("doc_id", "comp").distinct())
    least = own.groupBy("doc_id").agg(F.min("comp").alias("least"))
    joined = components(own.join(least, "doc_id").select(F.col("comp").alias("a"), F.col("least").alias("b")))
    joined = joined.select(F.col("node").alias("comp"), "root")
    classes, own = (rows.join(joined, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root") for rows in (classes, own))
    return materialize(classes), materialize(own.select("doc_id", "comp").distinct())


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs that stay, one document of each component: a row goes by its id, or by its text if it has none."""
    kept = _linked(docs, id_col, text_col, words, percent).where("kept")
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.when(F.col("doc_id").isNull(), F.col("node")).alias("kept_node")).distinct()
    own, node = F.col(id_col).cast("long"), _node(F.col(text_col))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("whole"), own.alias("own_id"), F.when(own.isNull(), node).alias("own_node"))
    match = F.col("own_id").eqNullSafe(F.col("kept_id")) & F.col("own_node").eqNullSafe(F.col("kept_node"))
    return rows.join(kept, match, "left_semi").select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
