"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles, as 64-bit hashes. Its parity sketch
has a bit for each hash value of a shingle, turned over by every shingle that
falls on it, so two sketches differ in no more bits than the sets have elements
apart. For sizes a and b and a similarity of at least t that is at most
D = (a + b)(1 - t)/(1 + t). The sketch is parted into D + 1 + k pieces: of two
linked documents at least k + 1 pieces are equal, bit for bit. Documents meet
where they share a piece (by a hash of its bits), and what meets is verified on
the sets themselves.

Pieces with hardly a bit set would gather documents that share nothing, so they
are left out. k of them may be: with at most k such pieces in one of two linked
documents, an equal piece is left. A document with more makes a sketch by another
hash as well, and by a third, until one has few enough; so a pair of which both
have too many meets there, and no link is lost. D depends on the sizes, so sketches are made per band of
sizes, and a document just above a band joins it too.

Groups of near copies are not expanded into pairs. Documents with one set are one
class, and a class is one node. In a bucket every node is verified against the
bucket's first node only; a second round does so where labels still differ;
and only in buckets that then still hold several components are nodes compared
across components, by Hamming distance in blocks, with the survivors verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import own_worker, scratch, small, staged
from cuelight.llm.components import components

#: Ratio of a band's ends.
BAND = 1.5
#: Bits of a piece.
PIECE_BITS = 16
#: Most sketches of a set in a band.
SKETCHES = 12
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: Candidate pairs for each node of a bucket above which only its nearest ones are looked at first, in so many rounds at most.
CROWDED, ROUNDS = 16, 3
#: Keys, the smallest ones, by which a node knows the buckets it is in.
LISTED = 32
WORDS_CACHED = 300_000
NO_ID = -(1 << 63)

U = np.uint64
_words: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that looks random."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of text, A-Z lower-cased;
    of fewer words the whole sequence is one shingle; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not found:
        return np.empty(0, U)
    own_worker("shingles", _words.clear)
    if len(_words) > WORDS_CACHED:
        _words.clear()
    try:
        h = np.array([_words[w] for w in found], U)
    except KeyError:
        for w in set(found):
            if w not in _words:
                _words[w] = xxhash.xxh64_intdigest(w)
        h = np.array([_words[w] for w in found], U)
    n = min(n, len(h))
    m = len(h) - n + 1
    acc = h[:m] + U(n)
    for j in range(1, n):
        acc = (acc ^ (acc >> U(29))) * U(0x9E3779B97F4A7C15) + h[j : j + m]
    return np.unique(mix(acc))


class Bands:
    """Size bands for a similarity of num / den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        size = 1
        while self.apart(size, size * den // num) < 1:
            size += 1
        self.first, self.starts, self.reach = size, [size], []  # below, only equal sets link

    def apart(self, a: int, b: int) -> int:
        """The most elements two linked sets of sizes a and b differ in."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[tuple[int, int, int, int]]:
        """(band, pieces, spare pieces, most bits of a piece left out) for each
        band a set of this size is in. Where pieces hold few shingles only empty
        ones can be left out, and more of them."""
        while self.starts[-1] <= size:
            end = int(self.starts[-1] * BAND) + 1
            self.reach.append((end - 1) * self.den // self.num)
            self.starts.append(end)
        out = []
        for j in range(len(self.starts) - 1):
            if self.starts[j] <= size <= self.reach[j]:
                d = self.apart(self.starts[j + 1] - 1, self.reach[j])
                full = self.starts[j] >= 5 * d
                spare = 2 + d // (16 if full else 5)
                out.append((j, d + 1 + spare, spare, 1 if full else 0))
        return out

    def width(self, band: int) -> int:
        """64-bit words of the sketches that are compared by Hamming distance: a
        bit or two for each shingle of the band's largest sets, of which strangers
        differ in about half."""
        return max(4, 1 << (self.starts[band + 1] // 64).bit_length())


def piece_keys(hashes: np.ndarray, band: int, pieces: int, spare: int, weak_bits: int) -> np.ndarray:
    """A hash of the bits of each piece that takes part, over as many sketches
    as it takes until one has few pieces to leave out."""
    out = []
    for again in range(SKETCHES):
        seed = U(((band + 1) << 8 | again) << 40)
        h = mix(hashes + seed) if again else hashes
        piece = ((h >> U(32)) * U(pieces)) >> U(32)
        bits = np.sort((piece << U(PIECE_BITS)) | (h & U((1 << PIECE_BITS) - 1)))
        if len(bits) > 1 and (bits[1:] == bits[:-1]).any():  # bits turned over twice
            bits, times = np.unique(bits, return_counts=True)
            bits = bits[times % 2 == 1]
        count = np.bincount((bits >> U(PIECE_BITS)).astype(np.int64), minlength=pieces)
        at = np.flatnonzero(count)
        keys = np.zeros(pieces, U)
        if len(at):
            starts = np.concatenate([[0], np.cumsum(count[at])[:-1]]).astype(np.int64)
            keys[at] = np.bitwise_xor.reduceat(mix(bits + seed), starts)
        keys = mix(keys + mix(np.arange(pieces, dtype=U) + seed))
        weak = count <= weak_bits
        if weak.sum() <= spare:
            return np.concatenate([*out, keys[~weak]])
        out.append(keys[~weak] if again + 1 < SKETCHES else keys)  # the last keeps all
    return np.concatenate(out)


def parity_sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """The sketch of 64 * words bits, a power of two."""
    bit = (hashes & U(words * 64 - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=words * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U)


def _marks(n: int):
    """Sizes of sets, and 128 bits that tell them apart."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch.column("text").to_pylist()]
            marks = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            yield pa.record_batch([batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy())], names=["doc", "n", "fa", "fb"])

    return make


def _pieces(n: int, num: int, den: int):
    """A row for each piece of each set that can link with another: its key, its node, the set's size."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            keys, nodes, sizes = [np.empty(0, U)], [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                s = shingle_set(text, n)
                for band in bands.of(len(s)) if len(s) >= bands.first else ():
                    keys.append(piece_keys(s, *band))
                    nodes.append((doc, len(keys[-1])))
                    sizes.append(len(s))
            times = [k for _, k in nodes]
            yield pa.record_batch([
                pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array([d for d, _ in nodes], np.int64), times)),
                pa.array(np.repeat(np.array(sizes, np.int32), times))], names=["key", "node", "n"])

    return make


def _sets(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "set"])

    return make


def _sketches(n: int, num: int, den: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            size, out = [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, n)
                size.append(len(s))
                out.append(parity_sketch(s, max([bands.width(b) for b, *_ in bands.of(len(s))], default=8)).tobytes())
            yield pa.record_batch([batch.column("doc"), pa.array(size, pa.int64()), pa.array(out, pa.binary())], names=["node", "n", "sketch"])

    return make


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch made narrower: the XOR of its halves is the sketch of half the width."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _near(num: int, den: int):
    """Pairs that sizes and the distance of their sketches don't rule out."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, a, b in zip(batch.column("sketch_a"), batch.column("sketch_b"), batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()):
                ok = a * num <= b * den and b * num <= a * den
                if ok:
                    x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                    words = min(len(x), len(y))
                    apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                    ok = apart * (den + num) <= (a + b) * (den - num)
                keep.append(ok)
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return test


def _verify(num: int, den: int):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(den * inter >= num * (len(x) + len(y) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return test


def _linked(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Small sketches rule out
    nearly all others first; only what is left has its sets made and joined."""
    a = sketches.select(F.col("node").alias("_a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = sketches.select(F.col("node").alias("_b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    near = staged(both.mapInArrow(_near(num, den), "a long, b long").distinct(), "near")
    nodes = staged(near.select(F.explode(F.array("a", "b")).alias("_n")).distinct(), "near-nodes")
    sets = staged(docs.join(small(nodes), F.col("doc") == F.col("_n"), "left_semi").mapInArrow(_sets(n), "node long, n long, set binary"), "sets")
    a, b = (sets.select(F.col("node").alias(f"_{k}"), F.col("set").alias(f"set_{k}")) for k in "ab")
    both = near.join(b, F.col("b") == F.col("_b")).join(a, F.col("a") == F.col("_a")).select("a", "b", "set_a", "set_b")
    return staged(both.mapInArrow(_verify(num, den), "a long, b long").distinct(), "links")


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, root) after further links between nodes."""
    if labels is None:
        return components(links)
    up = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    down = labels.select(F.col("node").alias("_m"), F.col("root").alias("_s"))
    edges = links.join(up, F.col("a") == F.col("_n"), "left").join(down, F.col("b") == F.col("_m"), "left").select(F.coalesce("_r", "a").alias("a"), F.coalesce("_s", "b").alias("b"))
    more = components(edges)
    known = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("root")))
    return staged(known.join(more.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "labels")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("node") == F.col("_n"), "left").select(*members.columns, F.coalesce("_r", "node").alias("label"))


def _met_before(key: int, lists: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each list of keys: the keys below `key` that several lists
    have. Two rows with a bit in common belong to nodes that meet in an earlier bucket too."""
    row = np.repeat(np.arange(len(lists)), [*map(len, lists)])
    keys = np.concatenate(lists)
    row, keys = row[keys < key], keys[keys < key]
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    several = times > 1
    bits = np.zeros((len(lists), max(1, -(-int(several.sum()) // 64)) * 64), bool)
    bits[row[several[at]], (np.cumsum(several) - 1)[at[several[at]]]] = True
    return np.packbits(bits, axis=1).view(U)


def _compare(num: int, den: int, crowded: float):
    """Pairs of the block pairs of some buckets that lie in different components
    and whose sketches are near enough for a link. A pair is a matter of the first
    bucket, by key, that both nodes list: there it is looked at in any case. Where a bucket has more than
    `crowded` for each node, only the nearest of each node, and whole is false."""

    def bucket(sketch, met, node, n, label, side, one: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
        words = min(map(len, sketch))
        sketch = np.vstack([folded(s, words) for s in sketch])
        left, right = (np.arange(len(node)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        out, best, found = [], [], 0
        for i in left:
            other = right[(label[right] != label[i]) & (node[right] != node[i])]
            other = other[~(met[other] & met[i]).any(axis=1)]
            apart = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            near = apart * (den + num) <= (n[other] + n[i]) * (den - num)
            other = other[near]
            if len(other):
                best.append((node[[i]], node[other[[np.argmin(apart[near])]]]))
            if one:
                other = other[node[other] > node[i]]
            found += len(other)
            if found <= crowded * len(node):
                out.append((np.full(len(other), node[i]), node[other]))
        return (out, True) if found <= crowded * len(node) else (best, False)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        sketch, lists = [np.frombuffer(s, U) for s in pdf["sketch"]], [*pdf["keys"]]
        key, node, n, label, side, ti, tj = (pdf[c].to_numpy() for c in ("key", "node", "n", "label", "side", "ti", "tj"))
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        out, whole = [], True
        for x, y in zip(cuts, cuts[1:]):
            pairs, all_ = bucket(sketch[x:y], _met_before(key[x], lists[x:y]), node[x:y], n[x:y], label[x:y], side[x:y], ti[x] == tj[x])
            out += pairs
            whole &= all_
        a = np.concatenate([np.empty(0, np.int64), *(p for p, _ in out)])
        b = np.concatenate([np.empty(0, np.int64), *(q for _, q in out)])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "whole": whole}).drop_duplicates()

    return across


def _across(members: DataFrame, labels: DataFrame, sketches: DataFrame, num: int, den: int, crowded: float) -> tuple[DataFrame, bool]:
    """Candidate pairs between components in the buckets that still hold several,
    and whether these are all. Small buckets go to tasks by the dozen; a large one
    is dealt into blocks, and each pair of blocks is a task's. Of crowded buckets
    only the nearest of each node come: they join most of a group of near copies,
    so that its pairs needn't all be made."""
    rows = _labelled(members.select("key", "node"), labels)
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi and _c > 2").select(F.col("key").alias("_k"), "_c", F.ceil(F.col("_c") / BLOCK).cast("int").alias("_blocks"))
    mixed = staged(mixed, "mixed")
    bins = max(1, (mixed.agg(F.sum("_c")).first()[0] or 0) // BLOCK)
    rows = rows.join(small(mixed), F.col("key") == F.col("_k"))
    lists = rows.groupBy(F.col("node").alias("_l")).agg(F.slice(F.sort_array(F.collect_set("key")), 1, LISTED).alias("keys"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    task = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key"))
    rows = rows.select("key", "node", "label", "_blocks", task.alias("task"), F.least("_own", "_other").alias("ti"), F.greatest("_own", "_other").alias("tj"), (F.col("_own") > F.col("_other")).cast("int").alias("side"))
    rows = rows.join(sketches.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).join(lists, F.col("node") == F.col("_l"))
    rows = rows.select("key", "_blocks", "task", "ti", "tj", "side", "node", "label", "n", "sketch", "keys")
    pairs = staged(rows.groupBy("_blocks", "task", "ti", "tj").applyInPandas(_compare(num, den, crowded), "a long, b long, whole boolean"), "pairs")
    return pairs.select("a", "b").distinct(), pairs.where("not whole").isEmpty()


def linked_documents(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs: two documents link
    when den * |A & B| >= num * |A | B| on their sets of n-word shingles, and
    component_id is the smallest doc_id reached by links.

    Null, empty and blank texts: no shingles, linked with nothing. Fewer than n
    words: the whole sequence is the one shingle. Rows with one doc_id are one
    document, linked through any of their texts; a null doc_id counts as the
    smallest, and its component_id is null. Empty table: no rows. Other columns
    of docs are not read.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    with scratch() as keep:
        signed = staged(docs.mapInArrow(_marks(n), "doc long, n long, fa long, fb long"), "marks")
        copies = signed.where("n > 0").groupBy("fa", "fb").agg(F.min("doc").alias("_first"), F.max("doc").alias("_last")).where("_first < _last")
        copies = staged(copies.select(F.col("fa").alias("_fa"), F.col("fb").alias("_fb"), "_first"), "copies")
        classed = signed.join(small(copies), (F.col("fa") == F.col("_fa")) & (F.col("fb") == F.col("_fb")) & (F.col("n") > 0), "left")
        classes = keep(staged(classed.select("doc", "n", F.coalesce("_first", "doc").alias("node")), "classes"))
        # copies of other documents stand for nothing of their own; keys are made anew from the texts rather than kept, as they take more room than these
        alike = classes.groupBy("doc").agg(F.max(F.col("doc") == F.col("node")).alias("_own")).where("not _own").select(F.col("doc").alias("_copy"))
        own = docs.join(small(staged(alike, "alike")), F.col("doc") == F.col("_copy"), "left_anti")
        members = staged(shared_pieces(own.mapInArrow(_pieces(n, num, den), "key long, node long, n int")), "members")
        labels = keep(staged(_labels(docs, members, classes, n, num, den), "labels"))

    out = classes.join(small(labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))), F.col("node") == F.col("_n"), "left")
    public = lambda c: F.when(c != NO_ID, c)
    return out.select(public(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), public(F.coalesce("_r", "node")).alias("component_id"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n), sorted, of the keys that several nodes have, with the
    key's first node and its size. Of what went before, only the last key is held."""
    held = None  # the last key, its first node and size, and whether its rows go out
    for batch in batches:
        key, node, n = (batch.column(c).to_numpy() for c in ("key", "node", "n"))
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        lead, of_lead, last = node[starts], n[starts], node[starts + sizes - 1]
        several = lead < last
        if held and key[0] == held[0]:
            lead[0], of_lead[0] = held[1:3]
            several[0] = held[3] or lead[0] < last[0]
            if several[0] and not held[3]:  # its first row, of the batch before, wasn't sent
                yield pa.record_batch([pa.array([x], k) for x, k in zip((held[0], held[1], held[2], held[1], held[2]), RUN_TYPES)], names=RUN_NAMES)
        out = np.repeat(several, sizes)
        held = (key[-1], lead[-1], of_lead[-1], bool(several[-1]))
        if out.any():
            cols = (key, node, n, np.repeat(lead, sizes), np.repeat(of_lead, sizes))
            yield pa.record_batch([pa.array(x[out], k) for x, k in zip(cols, RUN_TYPES)], names=RUN_NAMES)


RUN_NAMES = ["key", "node", "n", "lead", "n_lead"]
RUN_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]


def shared_pieces(keyed: DataFrame) -> DataFrame:
    """key, node, n, lead (the key's smallest node), n_lead of the keys of two
    nodes or more.

    The slim rows are exchanged once, by key, sorted inside their partitions and
    read as a stream, so a key of any number of nodes takes no memory. A
    document's pieces have many keys, so that even a third of all documents, if
    near copies, are a small part of a partition by each."""
    rows = keyed.repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(_runs, "key long, node long, n int, lead long, n_lead int")


def _labels(docs: DataFrame, members: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, root of the classes that links join."""
    nodes = staged(members.select(F.col("node").alias("_n")).distinct(), "nodes")
    sketches = staged(docs.join(small(nodes), F.col("doc") == F.col("_n"), "left_semi").mapInArrow(_sketches(n, num, den), "node long, n long, sketch binary"), "sketches")

    # a document of several texts may have a node of its own and some of copies: they are linked by it
    several = staged(classes.groupBy("doc").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select(F.col("doc").alias("_d"), "_lo"), "several")
    own = staged(classes.join(small(several), F.col("doc") == F.col("_d")).where("node <> _lo").select(F.col("_lo").alias("a"), F.col("node").alias("b")).distinct(), "own")

    # sets whose sizes are too far apart aren't linked, whatever they share
    sized = members.where((F.col("n") * num <= F.col("n_lead") * den) & (F.col("n_lead") * num <= F.col("n") * den))
    first = sized.where("node <> lead").groupBy("node").agg(F.min("lead").alias("a")).select("a", F.col("node").alias("b"))
    labels = _relabel(None, _linked(first, docs, sketches, n, num, den).unionByName(own))
    rows = _labelled(sized, labels)
    lead = labels.select(F.col("node").alias("_m"), F.col("root").alias("_s"))
    second = rows.join(lead, F.col("lead") == F.col("_m"), "left").where(F.coalesce("_s", "lead") != F.col("label")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    labels = _relabel(labels, _linked(second, docs, sketches, n, num, den))
    for crowded in (*[CROWDED] * ROUNDS, float("inf")):
        pairs, whole = _across(members, labels, sketches, num, den, crowded)
        labels = _relabel(labels, _linked(pairs, docs, sketches, n, num, den))
        if whole:
            break
    return labels


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs of each group of linked texts, that of the smallest doc_id
    (null first), with its own columns; texts decide, whatever their ids, so an id
    may keep several rows whose texts aren't linked. Rows without words are one
    document by their doc_id; one stays where no row of that id has words. Columns
    of any names are carried along. Empty table: no rows."""
    own = docs.columns
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_key")
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("_doc"), key, docs["text"].alias("text"))
    back = lambda kept: kept.select(*[F.col("_doc")[c].alias(c) for c in own])
    with scratch() as keep:
        if docs.groupBy(key).count().where("count > 1").isEmpty():
            linked = linked_documents(docs, n, num, den).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
            gone = keep(staged(linked.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_gone")), "gone"))
            return back(rows.join(small(gone), F.col("_key") == F.col("_gone"), "left_anti"))
        # ids don't tell rows apart: each row is a document under a number of its own
        rows = keep(staged(rows.withColumn("_row", F.monotonically_increasing_id()), "rows"))
        linked = linked_documents(rows.select(F.col("_row").alias("doc_id"), "text"), n, num, den)
        who = rows.select("_row", "_key", F.xxhash64("text").alias("_text"))
        linked = staged(linked.join(who, F.col("doc_id") == F.col("_row")).select("_row", "_key", "_text", "n_shingles", "component_id"), "linked")
        some, none = linked.where("n_shingles > 0"), linked.where("n_shingles = 0")
        best = some.groupBy("component_id").agg(F.min(F.struct("_key", "_text", "_row"))["_row"].alias("_stays")).select("_stays")
        blank = none.groupBy("_key").agg(F.min("_row").alias("_stays")).join(some.select("_key").distinct(), "_key", "left_anti").select("_stays")
        stays = keep(staged(best.unionByName(blank), "stays"))
        return back(rows.join(small(stays), F.col("_row") == F.col("_stays"), "left_semi"))


def oracle(n: int = 3, num: int = 90, den: int = 100) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, case when len(w) < {n} then array_to_string(w, ' ') else array_to_string(w[i:i + {n - 1}], ' ') end g
      from (select doc_id, w, unnest(range(1, greatest(2, len(w) - {n - 2}))) i from d where len(w) > 0)),
c as (select doc_id, count(*) n from s group by doc_id),
p as (select x.doc_id a, y.doc_id b, count(*) i from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
l as (select a, b from p join c ca on a = ca.doc_id join c cb on b = cb.doc_id where {den} * i >= {num} * (ca.n + cb.n - i)),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, coalesce(c.n, 0)::bigint n_shingles, least(d.doc_id, coalesce((select min(b) from r where r.a = d.doc_id), d.doc_id)) component_id from d left join c using (doc_id)"""
