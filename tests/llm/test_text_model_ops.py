"""Fill-in-middle, the backoff automaton and the prefix trie, against versions in plain Python."""

import hashlib
import math
import random
import re
import threading
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cuelight.llm import common, fim, language_model, prefix_trie
from data import SCHEMA, frame, rows

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, rows()).cache()


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# --- fill in the middle -------------------------------------------------------


def brute_fim(doc_id, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, t)
    if h[3] % 100 < 20:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_arranged(docs):
    got = sorted(map(tuple, fim.arranged(docs).collect()), key=str)
    assert got == sorted((brute_fim(r[0], r[1]) for r in rows()), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_restored_takes_odd_texts_apart(spark):
    odd = ["<P", "<", "<<S", "S>", "M><", "a<P>b", "<M>", ">", "😀é<S\n x", "<P<S<M", " ", "P>P>", "<S<P<M>"]
    data = [(i * 100 + k, t, "en", "s", 1, "x", "y", 1) for i in range(12) for k, t in enumerate(odd)]
    rows_ = fim.arranged(frame(spark, data)).select("doc_id", "form", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert len(rows_) == len(data)
    assert all(r.t == odd[r.doc_id % 100] for r in rows_)
    assert {"spm", "psm", "plain"} == {r.form for r in rows_ if r.doc_id % 100 in (1, 3, 4, 7)}
    assert all(r.form == "plain" for r in rows_ if odd[r.doc_id % 100] in ("a<P>b", "<M>", "<S<P<M>"))


def test_fim_very_long_text_and_empty_table(spark):
    long = "word, " * 200_000
    r = fim.digests(frame(spark, [(5, long, "en", "s", 1, "x", "y", 1)])).first()
    want = brute_fim(5, long)
    assert tuple(r) == (*want[:5], sha(want[5]), sha(long)) and r.n == 600_000
    assert fim.digests(spark.createDataFrame([], SCHEMA)).count() == 0


# --- the backoff automaton ----------------------------------------------------


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL)) + [None]


def brute_scores(data, order, prior):
    """The smoothed probability from whole counts, by recursion over contexts."""
    grams = [Counter() for _ in range(order + 1)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    for i, t in data:
        if not held(i):
            seq = [None, *tokens(t)]
            for k in range(1, len(seq)):
                for n in range(1, min(order, k + 1) + 1):
                    grams[n][tuple(seq[k - n + 1 : k + 1])] += 1
    total, types = sum(grams[1].values()), len(grams[1])

    def p(context, w):
        if not context:
            return (grams[1][(w,)] + 0.5) / (total + 0.5 * (types + 1))
        m = prior[min(len(context) - 1, len(prior) - 1)]
        return (grams[len(context) + 1][(*context, w)] + m * p(context[1:], w)) / (grams[len(context)][context] + m)

    out = []
    for i, t in data:
        seq = [None, *tokens(t)]
        base = sum(math.log10(p((), w)) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, k - order + 1) : k]), seq[k])) for k in range(1, len(seq)))
        out.append((i, held(i), len(seq) - 1, sum(grams[1][(w,)] > 0 for w in seq[1:]), total, base, score))
    return out


def same_scores(got, want):
    got, want = (sorted(map(tuple, x), key=str) for x in (got, want))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(docs, order):
    data = [(r[0], r[1]) for r in rows()]
    same_scores(language_model.scores(docs, order).collect(), brute_scores(data, order, language_model.PRIOR))


def test_scores_in_small_blocks_and_pieces(docs):
    """Blocks of some 30 words: long texts are cut, and read on in the state they were left in."""
    data = [(r[0], r[1]) for r in rows()]
    got = language_model.scores(docs.repartition(3), 3, block_bytes=200, range_bytes=5000).collect()
    same_scores(got, brute_scores(data, 3, language_model.PRIOR))


def test_scores_are_the_same_to_the_last_bit_however_texts_are_dealt(docs):
    one, other = (sorted(map(tuple, language_model.scores(d, 2, block_bytes=b).collect()), key=str) for d, b in ((docs.coalesce(1), 8 << 20), (docs.repartition(4), 900)))
    assert one == other


def test_probabilities_of_a_context_sum_to_one():
    """Over the words that were counted and one that was not, from every state."""
    import numpy as np

    words = np.array([0, 1, 2, 1, 2, 3, 1, 1, 2, 0])  # 0 is the end; 4 was never counted
    counts = [np.bincount(words[1:], minlength=5)]
    pairs = sorted({*zip(words.tolist(), words[1:].tolist())})
    seen = Counter(zip(words.tolist(), words[1:].tolist()))
    places = np.array([next(k for k in range(1, len(words)) if (words[k - 1], words[k]) == x) for x in pairs])
    counts.append(np.array([seen[x] for x in pairs]))
    machine = language_model.Automaton([words], [None, places], counts, int(counts[0].sum()), 4, (2.0,))
    for state in range(5):
        assert sum(10 ** (machine.read([w], state)[0] / language_model.UNIT) for w in range(5)) == pytest.approx(1, abs=1e-9)


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(5)
    follow = {w: [rng.randrange(300) for _ in range(4)] for w in range(300)}

    def text():
        w, out = rng.randrange(300), []
        for _ in range(80):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    got = language_model.scores(spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 40 and sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)


def test_scores_of_nothing(spark):
    assert language_model.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    only_held = language_model.scores(frame(spark, [(2, "a b", "en", "s", 1, "x", "y", 1)])).first()  # 2 is not held out
    assert only_held.train_tokens == 3
    nothing = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:1]
    r = language_model.scores(frame(spark, [(nothing[0], "a b", "en", "s", 1, "x", "y", 1)])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


# --- the prefix trie ----------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, a string, n_convs long"


def brute_trie(data):
    own = defaultdict(list)
    for c, t, role, text, *_ in data:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        root = own.get(c - int(math.fmod(c, 100)), [])
        full = root[:h] + turns[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items())


def trie_rows(spark, data):
    got = prefix_trie.trie(spark.createDataFrame(data, TURNS))
    return sorted(map(tuple, got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def test_trie_of_random_conversations(spark):
    rng = random.Random(8)
    data = []
    for c in [*range(0, 90), *range(100, 130), 205, -3, -100, -150]:
        for t in range(rng.randrange(1, 7)):
            data.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "", None, "so?", "é😀", "ab"]), 1, "x", 9))
    data += [(7, None, "user", "before", 1, "x", 9), (8, 2, "z", "tie", 1, "x", 9), (8, 2, "a", "tie", 1, "x", 9), (8, 2, "a", "tie", 1, "x", 9), (None, 1, "user", "nobody", 1, "x", 9), (None, None, None, None, None, None, None)]
    data += [data[0], data[3]]
    assert trie_rows(spark, data) == brute_trie(data)


def test_trie_of_deep_conversations(spark, monkeypatch):
    """Hundreds of turns, in runs of 16, with copies that end at several depths."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    data = [(c, t, "user", f"turn {t}" if t < cut else f"{c} at {t}", 1, "x", 9) for c, size, cut in ((1, 300, 300), (2, 300, 290), (3, 120, 120), (4, 301, 17), (5, 1, 1), (111, 300, 300)) for t in range(size)]
    assert trie_rows(spark, data) == brute_trie(data)


def test_trie_of_many_copies_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 20)
    data = [(1000 + c, t, "user", "same", 1, "x", 9) for c in range(300) for t in range(2)] + [(2000, 0, "user", "long " * 20_000, 1, "x", 9)]
    assert trie_rows(spark, data) == brute_trie(data)
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x", 1, "x", 9)], TURNS)).count() == 0


# --- scratch tables -----------------------------------------------------------


def test_threads_keep_their_own_scratch_tables(spark):
    """One thread leaves its scratch() while the other still reads a table staged in its own."""
    there, gone = threading.Event(), threading.Event()
    found = {}

    def first():
        with common.scratch():
            mine = common.staged(spark.range(5).toDF("x"), "first")
            there.set()
            gone.wait(60)
            found["first"] = mine.count()

    def second():
        there.wait(60)
        with common.scratch() as keep:
            lost = common.staged(spark.range(3).toDF("x"), "second")
            kept = keep(common.staged(spark.range(4).toDF("x"), "kept"))
        gone.set()
        found["kept"] = kept.count()
        try:
            found["lost"] = lost.count()
        except Exception as e:
            found["lost"] = type(e).__name__

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert found["first"] == 5 and found["kept"] == 4 and isinstance(found["lost"], str)
