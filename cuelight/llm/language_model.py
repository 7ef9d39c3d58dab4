"""Scores of texts under a smoothed n-gram model, as a weighted backoff automaton.

Training counts n-grams of all training texts. Smoothing is by Dirichlet priors:
an n-gram's probability is (count + M * that of its suffix) / (count of its
context + M), which sums to 1 over the words and one unknown word. A context that
was counted is a state; its counted continuations are arcs, each with its
log-probability and the state it leads to; its failure arc leads to the state of
the context without its first word, at the log of M / (count + M). A text is read
once from left to right from the state of a text's end: a word without an arc
takes failure arcs until there is one.

The automaton of a whole corpus is as large as the corpus, so it is never in one
place. Texts are dealt to blocks of bounded size; a block asks for the counts of
its own n-grams (64-bit hashes in sorted runs, one for each range of hashes that
it touches), ranges of hashes add up the counts of all blocks and answer each,
and a block builds the part of the automaton that its texts can reach.
Log-probabilities are whole numbers of 1e-10, so sums don't hang on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import crc32_sql

ORDER = 2
#: Weight of the shorter context, in words, by the n-gram's length from 2 on; the last holds for longer
#: ones. On held-out texts of sf0.1 the best of ten values for pairs and of six for triples.
PRIOR = (500.0, 5.0)
#: Bytes of texts of a block, and of texts whose n-grams fall in one range of hashes; ranges at least.
BLOCK_BYTES, RANGE_BYTES, LEAST_RANGES = 6 << 20, 16 << 20, 64
#: Bytes of texts that are cut into words at once.
SLICE = 8 << 20
BLANK = " \t\n\x0b\x0c\r"
#: Hashes are even; the last bit says, while n-grams are counted, that one is of a training text.
EVEN = np.uint64(2**64 - 2)
#: What stands for a text's end among the hashes of words.
END = np.uint64(0xD1B54A32D192ED02)
#: Parts of a log-probability of 1: sums of whole parts don't hang on their order. An arc is one
#: number, its parts above STATES bits for the state it leads to.
UNIT, STATES = 10**10, 24

COUNTS = "bucket int, block long, part int, n long, keys binary, counts binary, texts binary"


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of distinct words, which of them each word of the texts is, words of each text)."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_trim(pc.ascii_lower(texts), BLANK))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().dictionary_encode()
    at = flat.indices.to_numpy()
    keys = np.fromiter(map(xxhash.xxh64_intdigest, flat.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(flat.dictionary)) & EVEN
    blank = pc.index(flat.dictionary, "").as_py()  # the one piece of a text without words
    if blank >= 0:
        of_text = np.repeat(np.arange(len(sizes)), sizes)[at == blank]
        sizes = sizes - np.bincount(of_text, minlength=len(sizes))
        at = at[at != blank]
    return keys, at, sizes


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts are of bounded size."""
    sizes = pc.binary_length(batch.column("text").cast(pa.binary())).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, from those of all but their last word and of that word."""
    x = keys * np.uint64(0x9E3779B97F4A7C15) + words
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & EVEN


def planes(values: np.ndarray) -> bytes:
    """Bytes of like weight together, compressed: most of them are zeros, or few values."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), codec="zstd", asbytes=True)


def unplanes(raw: bytes, size: int, dtype) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, size * wide, codec="zstd"), np.uint8).reshape(wide, -1).T).view(dtype).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted hashes as their distances."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.cumsum(unplanes(raw, size, np.uint64), dtype=np.uint64)


def by_range(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the runs of sorted hashes that fall in one range."""
    at = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
    return [(int(at[a]), a, b) for a, b in zip(cuts, [*cuts[1:], len(keys)])]


def runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def tallied(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and how often each stands at a place of training."""
    marked = np.sort(keys | trains.astype(np.uint64))
    keys = marked & EVEN
    first = runs(keys)
    return keys[first], np.add.reduceat(marked & np.uint64(1), first).astype(np.uint32)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, the sums of their counts, and that sum at each of the given places."""
    order = np.argsort(keys)
    keys = keys[order]
    first = runs(keys)
    sums = np.add.reduceat(counts[order], first)
    each = np.empty(len(keys), np.int64)
    each[order] = np.repeat(sums, np.diff(first, append=len(keys)))
    return keys[first], sums, each


class Grams:
    """The n-grams of a run of words: for each length the hash of the n-gram that
    ends at each place, where it lies in one text."""

    def __init__(self, words: np.ndarray, age: np.ndarray, order: int):
        """age: how many words of the same text stand before each place."""
        self.keys, self.there = [words], [np.ones(len(words), bool)]
        for n in range(2, order + 1):
            there = age >= n - 1
            keys = np.zeros(len(words), np.uint64)
            keys[1:] = longer(self.keys[-1][:-1], words[1:])
            self.keys.append(keys)
            self.there.append(there)


def pieces(words: np.ndarray, most: int, order: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(piece, context words, words) of a text with END before and after it.
    A piece begins with the words that the state at its start stands for."""
    seq = np.concatenate([[END], words, [END]]).astype(np.uint64)
    for k, at in enumerate(range(1, len(seq), most)):
        context = min(order - 1, at)
        yield k, context, seq[at - context : at + most]


def vocabulary(docs: DataFrame, ranges: int) -> DataFrame:
    """types, tokens by range: distinct and all tokens of the training texts, END included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch):
                keys, at, _ = word_keys(part.column("text"))
                held.append((np.append(keys, END), np.append(np.bincount(at, minlength=len(keys)), part.num_rows)))
                if sum(len(k) for k, _ in held) > 1 << 21:
                    held = [merged(held)]
                    if len(held[0][0]) > 1 << 20:
                        yield send(*held.pop())
        if held:
            yield send(*merged(held))

    def merged(held):
        keys, counts, _ = summed(*map(np.concatenate, zip(*held)))
        return keys[counts > 0], counts[counts > 0]

    def send(keys, counts):
        cuts = by_range(keys, ranges)
        columns = [pa.array([c[0] for c in cuts], pa.int32()), pa.array([b - a for _, a, b in cuts], pa.int64()), *[pa.array([f(x[a:b]) for _, a, b in cuts], pa.binary()) for f, x in ((packed, keys), (planes, counts))]]
        return pa.record_batch(columns, names=["bucket", "n", "keys", "counts"])

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys, counts, _ = summed(np.concatenate([unpacked(r["keys"], r["n"]) for r in rows]), np.concatenate([unplanes(r["counts"], r["n"], np.int64) for r in rows]))
        return pa.table({"types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    sent = docs.where("not held_out").select("text").mapInArrow(count, "bucket int, n long, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "types long, tokens long")


def asked(docs: DataFrame, ranges: int, order: int, block_bytes: int) -> DataFrame:
    """Rows of COUNTS: of each block its texts (sent to any range), and for each
    n-gram length and range the hashes it has there with their counts in training
    texts. docs: doc_id, held_out, text."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = (task.partitionId() if task else 0) << 33
        most = max(order, block_bytes // 6)  # words of a block
        block, size, made, row = [], 0, 0, 0
        for batch in batches:
            for cut in slices(batch):
                keys, at, sizes = word_keys(cut.column("text"))
                ends = np.cumsum(sizes)
                for doc, held, a, b in zip(cut.column("doc_id").to_pylist(), cut.column("held_out").to_pylist(), (ends - sizes).tolist(), ends.tolist()):
                    for piece, context, run in pieces(keys[at[a:b]], most, order):
                        if size and size + len(run) > most:
                            yield from send(block, part | made)
                            block, size, made = [], 0, made + 1
                        block.append(((part | row, doc or 0, doc is None, held, piece, context, len(run)), run))
                        size += len(run)
                    row += 1
        if block:
            yield from send(block, part | made)

    def send(block: list, number: int) -> Iterator[pa.RecordBatch]:
        head = np.array([h for h, _ in block], np.int64)
        words = np.concatenate([run for _, run in block])
        text = Texts(head)
        vocab, local = np.unique(words, return_inverse=True)
        grams = Grams(vocab[local], text.age, order)
        out = [(((number >> 33) + number) * 2654435761 % (1 << 32) * ranges >> 32, number, 0, len(local), head.tobytes(), None, planes(local.astype(np.uint32)))]
        for n in range(1, order + 1):
            used = text.used(grams, n, order)
            keys, counts = tallied(grams.keys[n - 1][used], text.trains[used])
            out += [(bucket, number, n, b - a, packed(keys[a:b]), planes(counts[a:b]), None) for bucket, a, b in by_range(keys, ranges)]
        for k in range(0, len(out), 256):
            yield from _table(out[k : k + 256]).to_batches()

    return docs.mapInArrow(ask, COUNTS)


class Texts:
    """Places of a block's words: age, how many words of the same piece stand
    before; scored, not context only; trains, of a training text."""

    def __init__(self, head: np.ndarray):
        """head: row, doc_id, is it null, held out, piece, words that are context only, words."""
        sizes = head[:, 6]
        self.age = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.scored = self.age >= np.repeat(head[:, 5], sizes)
        self.trains = self.scored & np.repeat(head[:, 3] == 0, sizes)

    def used(self, grams: Grams, n: int, order: int) -> np.ndarray:
        """Places whose n-gram is asked for: context words only take part in states."""
        return grams.there[n - 1] & self.scored if n == order > 1 else grams.there[n - 1]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ("bucket", "block", "part", "n", "keys", "counts", "texts")
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})


def answered(group: pa.Table) -> pa.Table:
    """Counts over all blocks, for each block's hashes of one range; of words the
    hashes too. Lengths of n-grams share the space of hashes."""
    rows = group.to_pylist()
    out = [tuple(r.values()) for r in rows if r["part"] == 0]
    sent = [r for r in rows if r["part"]]
    if sent:
        keys = np.concatenate([unpacked(r["keys"], r["n"]) for r in sent])
        counts = np.concatenate([unplanes(r["counts"], r["n"], np.uint32) for r in sent]).astype(np.int64)
        _, _, each = summed(keys, counts)
        at = 0
        for r in sent:
            out.append((r["bucket"], r["block"], r["part"], r["n"], r["keys"] if r["part"] == 1 else None, planes(each[at : at + r["n"]]), None))
            at += r["n"]
    return _table(out)


class Automaton:
    """States, arcs and failure arcs that a block's texts can take."""

    def __init__(self, ids: list[np.ndarray], used: list[np.ndarray], counts: list[np.ndarray], tokens: int, types: int, prior):
        """ids: for each length the number of the n-gram that ends at each place; used:
        for each length one place of each n-gram, in the order of their numbers;
        counts: their training counts."""
        order, width = len(counts), len(counts[0])
        total = tokens + 0.5 * (types + 1)
        p = (counts[0] + 0.5) / total
        self.width, self.words, self.unknown = width, units(p), int(units(np.array([0.5 / total]))[0])
        # state 0 is the empty context, then come the words, the pairs, ...; what was never counted leads to its suffix's state
        state = np.where(counts[0] > 0, 1 + np.arange(width), 0) if order > 1 else np.zeros(width, np.int64)
        fails, states = np.zeros(width, np.int64), 1 + width
        back, fail = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        seen = np.flatnonzero(counts[0])
        arcs = [(seen, self.words[seen], state[seen])]
        for n in range(2, order + 1):
            m, of_context = prior[min(n - 2, len(prior) - 1)], counts[n - 2]
            back.append(units(m / (of_context + m)))
            fail.append(fails)
            place = used[n - 1]
            context, suffix, word = ids[n - 2][place - 1], ids[n - 2][place], ids[0][place]
            p = (counts[n - 1] + m * p[suffix]) / (of_context[context] + m)
            fails = state[suffix]
            reach = np.where(counts[n - 1] > 0, states + np.arange(len(p)), fails) if n < order else fails
            seen = np.flatnonzero(counts[n - 1])
            arcs.append((state[context[seen]] * width + word[seen], units(p[seen]), reach[seen]))
            state, states = reach, states + len(p)
        if states >= 1 << STATES:
            raise ValueError("a block has too many states: take smaller ones")
        key, weight, target = map(np.concatenate, zip(*arcs))
        self.arcs = dict(zip(key.tolist(), (weight << STATES | target).tolist()))
        self.back, self.fail = np.concatenate(back).tolist(), np.concatenate(fail).tolist()

    def read(self, words: list[int], state: int) -> tuple[int, int]:
        """(log-probability of the words, in units; the state after them)."""
        arcs, back, fail, width = self.arcs.get, self.back, self.fail, self.width
        unknown, low = self.unknown << STATES, (1 << STATES) - 1
        total = 0
        for w in words:
            arc = arcs(state * width + w)
            while arc is None:
                if state:
                    total += back[state]
                    state = fail[state]
                    arc = arcs(state * width + w)
                else:
                    arc = unknown
            total += arc >> STATES
            state = arc & low
        return total, state


def units(p: np.ndarray) -> np.ndarray:
    return np.rint(np.log10(p) * UNIT).astype(np.int64)


FOUND = "row long, doc_id long, held_out boolean, piece int, n_tokens long, n_known long, base string, total string"


def scored(group: pa.Table, order: int, tokens: int, types: int, prior) -> pa.Table:
    """A block's texts and answers as rows of FOUND, the sums in units."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["bucket"]))
    head = np.frombuffer(rows[0]["keys"], np.int64).reshape(-1, 7)
    local = unplanes(rows[0]["texts"], rows[0]["n"], np.uint32).astype(np.int64)
    counts = [np.concatenate([unplanes(r["counts"], r["n"], np.int64) for r in rows if r["part"] == k] or [np.zeros(0, np.int64)]) for k in range(1, order + 1)]
    vocab = np.concatenate([unpacked(r["keys"], r["n"]) for r in rows if r["part"] == 1])
    rows.clear()
    text = Texts(head)
    grams = Grams(vocab[local], text.age, order)
    ids, used = [local], [None]
    for k in range(2, order + 1):
        place = np.flatnonzero(text.used(grams, k, order))
        by = np.argsort(grams.keys[k - 1][place])
        first = runs(grams.keys[k - 1][place[by]])
        used.append(place[by[first]])
        if k < order:
            number = np.full(len(local), -1, np.int64)
            number[place[by]] = np.repeat(np.arange(len(first)), np.diff(first, append=len(by)))
            ids.append(number)
    del grams
    machine = Automaton(ids, used, counts, tokens, types, prior)
    known = counts[0] > 0
    out, at = [], 0
    for row, doc, null, held, piece, context, size in head.tolist():
        run = local[at : at + size].tolist()
        state = machine.read(run[:context], 0)[1]
        total = machine.read(run[context:], state)[0]
        own = local[at + context : at + size]
        base = sum(machine.words[own].tolist())
        out.append((row, None if null else doc, bool(held), piece, len(own), int(known[own].sum()), str(base), str(total)))
        at += size
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [f.split()[0] for f in FOUND.split(", ")]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out), kinds)})


def scores(docs: DataFrame, order: int = ORDER, prior=PRIOR, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Texts whose crc32(doc_id as text) is 1 modulo 5 are held out of training; a
    null id is an empty text there, so it trains. Null and empty texts are one
    token, the end. Repeated rows train and are scored each. Very long texts are
    cut into pieces that begin in the state where the last one ended, which is
    known from its last words. Words are told apart by 64-bit hashes. Empty table:
    no rows. Other columns aren't read.
    """
    if order < 1:
        raise ValueError("order must be 1 at least")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(ident) % 5 == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, math.ceil(size / range_bytes))
    total = vocabulary(rows, ranges).agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = total[0] or 0, total[1] or 0
    replies = asked(rows, ranges, order, block_bytes).groupBy("bucket").applyInArrow(answered, COUNTS)
    found = replies.groupBy("block").applyInArrow(lambda group: scored(group, order, tokens, types, prior), FOUND)
    summed = lambda c: (F.sum(F.col(c).cast("decimal(28,0)")).cast("double") / F.lit(float(UNIT)))
    out = found.groupBy("row", "doc_id", "held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), summed("base").alias("base_score"), summed("total").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def oracle(prior=PRIOR) -> str:
    """The model of order 2 in closed form: what the automaton adds up is log10 of the smoothed probability."""
    m = f"{prior[0]}::double"
    log = lambda p: f"round(log10({p}) * {UNIT}::double)::hugeint"
    return rf"""
with d as (select row_number() over () id, doc_id, {crc32_sql("coalesce(doc_id::varchar, '')")} % 5 = 1 held_out,
   list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), ' ') w from documents),
t as (select id, held_out, unnest(w) w, unnest(list_prepend(' ', w[:len(w) - 1])) v from d),
c1 as (select w, count(*) filter (not held_out) c from t group by w),
n as (select sum(c)::bigint n, count(*) filter (c > 0) types from c1),
p1 as (select w, c, (c + 0.5::double) / (n + 0.5::double * (types + 1)) p from c1, n),
c2 as (select v, w, count(*) filter (not held_out) c from t group by v, w),
p2 as (select c2.v, c2.w, b.c > 0 known, {log('b.p')} base, case when c2.c > 0 then {log(f'(c2.c + {m} * b.p) / (a.c + {m})')} else case when a.c > 0 then {log(f'{m} / (a.c + {m})')} else 0 end + {log('b.p')} end score
   from c2 join p1 a on a.w = c2.v join p1 b on b.w = c2.w)
select any_value(d.doc_id) doc_id, any_value(d.held_out) held_out, count(*) n_tokens, count(*) filter (known) n_known, any_value(n.n) train_tokens, sum(base)::double / {UNIT}::double base_score, sum(score)::double / {UNIT}::double score
from (select id, doc_id, held_out from d) d join (select id, v, w from t) t using (id) join p2 using (v, w), n group by d.id"""
