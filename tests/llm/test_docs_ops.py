"""Operators on documents against brute force, on a table of awkward cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from data import SCHEMA, frame, rows

from cuelight.llm import arrow_store, jaccard, mixing, packing, quality, sharding
from cuelight.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, default_path

BLANK = " \t\n\x0b\f\r"


def words(t):
    out, w = [], ""
    for c in t or "":
        if c in BLANK:
            if w:
                out.append(w)
            w = ""
        else:
            w += c
    return out + [w] * bool(w)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, rows())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).where("false")


def mark_of(text):
    """What makes documents distinct: the least md5 of their 5-word windows."""
    w = words(text)
    return min(hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest() for i in range(max(1, len(w) - 4)))


def brute_quality(data, share, least):
    lines, hosts = defaultdict(set), defaultdict(set)
    norm = lambda x: " ".join("".join("0" if k == "0" else k for k in re.sub("[0-9]+", "0", x.lower())).split())
    for r in data:
        if r[1] is not None:
            hosts[r[3]].add(mark_of(r[1]))
            for x in r[1].split("\n"):
                if words(x):
                    lines[r[3], norm(x)].add(mark_of(r[1]))
    want = []
    for r in data:
        t = r[1] or ""
        w = words(t)
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cov = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
        ls = [x for x in t.split("\n") if words(x)]
        lost = sum(len(words(x)) for x in ls if (n := len(lines[r[3], norm(x)])) > least and n > share * len(hosts[r[3]]))
        bad = len(w) < 50 or 100 * len(cov) > 50 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(cov), bad, not bad and len(w) - lost >= 0.3 * len(w), len(w) - lost))
    return sorted(want, key=str)


def test_quality_base(docs):
    got = sorted(map(tuple, quality.quality(docs, share=0.2, least=2).collect()), key=str)
    assert got == brute_quality(rows(), 0.2, 2)
    assert any(r[6] is False and r[7] for r in got)


def test_quality_null_texts_are_no_documents(spark):
    """Of two texts and a null, a line of one text is in half of the documents."""
    text = lambda k: "One line that is held\n" * (k == 0) + " ".join(f"{k}w{i}" for i in range(60))
    data = [(1, text(0), "en", "a", 0, "", "", 0), (2, text(1), "en", "a", 0, "", "", 0), (3, None, "en", "a", 0, "", "", 0)]
    got = sorted(map(tuple, quality.quality(frame(spark, data), share=0.4, least=0).collect()), key=str)
    assert got == brute_quality(data, 0.4, 0) and got[0][-1] == 0


def test_planted_lines_go_and_copies_stay(spark):
    """Production limits: a line in 12 of 300 documents goes, a document of hardly
    anything else is rejected, and a group of near copies keeps its lines."""
    import random

    rng = random.Random(8)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    line, notice = "Planted line 17 of this host", "\n".join(f"notice {k} " + " ".join(f"n{k}x{j}" for j in range(12)) for k in range(8))
    data = [(i, own(80) + ("\n" + line if i % 25 == 0 else "") + "\n" + own(30)) for i in range(300)]
    data += [(400 + i, notice + "\n" + own(40)) for i in range(60)]
    base = own(400).split()
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = own(1)
        data.append((500 + i, "\n".join(" ".join(w[k : k + 40]) for k in range(0, 400, 40))))
    docs = frame(spark, [(i, t, "en", "h", 0, "", "", 0) for i, t in data])
    assert sorted(map(tuple, quality.quality(docs).collect()), key=str) == brute_quality([(i, t, "en", "h") for i, t in data], quality.SHARE, quality.LEAST)
    got = {r.doc_id: r.text for r in quality.cleaned(docs).collect()}
    assert set(got) == {i for i, _ in data if not 400 <= i < 500}
    assert not any(line in t for t in got.values())
    assert all(got[i] == t for i, t in data if i >= 500)


def test_quality_cleaned(docs):
    kept = quality.cleaned(docs, share=0.2, least=2)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert r.n_chars == len(r.text) and "Shared line of the host" not in r.text


def test_mix_totals(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    size = {i: len(words(r[1])) for i, r in enumerate(rows())}
    by = defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r)
        assert r.taken in (0, r["size"], 2 * r["size"])
    total = sum(size.values())
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    for (source_size, target), rs in by.items():
        assert sum(r["size"] for r in rs) == source_size
        assert target <= 2 * source_size
        units = Counter()
        for r in rs:
            units[r.doc_id, r["size"]] += r["size"]
        assert abs(sum(r.taken for r in rs) - target) <= max(units.values()) / 2 + 1e-6
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    taken = Counter({})
    for r in got:
        taken[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.mixed_rows(docs).collect()) == +taken
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_pareto_probabilities(spark):
    """Over many seeds a document is drawn about as often as its odds say."""
    docs = spark.createDataFrame([(i, "w " * (10 + i), "a") for i in range(40)] + [(100 + i, "w " * 200, "b") for i in range(20)], "doc_id long, text string, source string")
    base = mixing.staged(mixing.sizes(docs))
    plan = mixing.staged(mixing.with_rate(base, mixing.source_targets(base)))
    rate = {r.source: r.rate for r in plan.collect()}
    rest = {r.source: r.rest for r in plan.collect()}
    sizes = {r.doc_id: (r.source, r["size"]) for r in base.collect()}
    whole = {r.source: r.whole for r in plan.collect()}

    def draw(seed):
        """The ids of one draw, by a plain loop over the ranking."""
        out = set()
        for source in rate:
            keys, words_ = [], 0
            for i, (s, n) in sizes.items():
                p = min(1.0, rate[s] * n)
                if s == source and p > 0:
                    u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                    keys.append((u / (1 - u) / (p / (1 - p)) if p < 1 else 0.0, i, n))
            for _, i, n in sorted(keys):
                if rest[source] - words_ <= n / 2:
                    break
                out.add(i)
                words_ += n
        return out

    seeds = 400
    drawn = Counter(i for seed in range(seeds) for i in draw(seed))
    for i, (s, n) in sizes.items():
        p = min(1.0, rate[s] * n)
        assert abs(drawn[i] / seeds - p) < 0.12, (i, drawn[i] / seeds, p)
    for seed in (7, 8):
        got = {r.doc_id: r.copies for r in mixing.mix(docs, seed=str(seed)).collect()}
        assert {i for i, c in got.items() if c > whole[sizes[i][0]]} == draw(seed)


def brute_components(data, n, num, den):
    sets = defaultdict(list)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in data:
        w = words((r[1] or "").translate(low))
        sets[r[0]].append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    key = lambda x: -(1 << 63) if x is None else x
    for a, b in itertools.combinations(sets, 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((find(a), find(b)), key=key)
            up[b] = a
    return Counter((k, len(s), find(k)) for k, own in sets.items() for s in own)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard_components(docs, n, num, den):
    got = Counter(map(tuple, jaccard.linked_documents(docs, n, num, den).collect()))
    assert got == brute_components(rows(), n, num, den)


@pytest.mark.parametrize("crowded", [jaccard.CROWDED, 0])
def test_jaccard_near_copies(spark, monkeypatch, crowded):
    """A cloud of near copies around one text, with chains at the threshold."""
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    data = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.linked_documents(docs).collect())) == brute_components(data, 3, 90, 100)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = np.unique(np.concatenate([a[: rng.integers(100, 200)], rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64)]))
        x, y = jaccard.parity_sketch(a, 16), jaccard.parity_sketch(b, 16)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    want = {c for _, _, c in brute_components(rows(), 5, 80, 100)}
    assert len(ids) == len(set(ids)) and set(ids) == want and kept.columns == docs.columns


def test_token_files(docs):
    enc = __import__("tokenizers").Tokenizer.from_file(default_path(BYTE_BPE))
    uri, places = arrow_store.write_tokens(docs, seq_len=64)
    got = arrow_store.read_digests(uri, places).collect()
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in rows():
        ids = np.array([*enc.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        by[r[0]].append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        by[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)


def test_stream_file_round_trip():
    ids = np.arange(100_003, dtype=np.uint32) * 7 % 50_000
    raw = arrow_store.encode_to_bytes(ids, seq_len=128)
    reader = arrow_store.StreamReader(__import__("pyarrow").py_buffer(raw))
    assert (reader.tokens(0, len(ids)) == ids).all()
    assert (reader.sequence(5, 128) == ids[640:768]).all()
    assert reader.sequence(5, 128).base is not None  # a view, not a copy


def test_token_stores_and_readers(tmp_path):
    """Files are mapped, and read forward with a batch held at most; places of a
    store that can't be reached are an error, not a crash of an executor."""
    ids = np.arange(300_000, dtype=np.uint32) % 50_000
    path = tmp_path / "x.arrows"
    path.write_bytes(arrow_store.encode_to_bytes(ids, seq_len=64))
    store, root = arrow_store.open_store(f"file://{tmp_path}")
    reader = arrow_store.StreamReader(arrow_store.opened(store, f"{root}/x.arrows"), forward=True)
    for at in range(0, 300_000, 7000):
        n = min(9000, 300_000 - at)
        assert (reader.tokens(at, n) == ids[at : at + n]).all() and sum(map(len, reader.ids)) <= 9000 + 2 * 64 * arrow_store.BATCH
    assert reader.tokens(290_000, 10).base is not None
    with pytest.raises(ValueError, match="wasb"):
        arrow_store.open_store("wasb://a/b")


def test_packing(docs):
    enc = __import__("tokenizers").Tokenizer.from_file(default_path(WORD_BPE))
    got = packing.packed_digests(docs, capacity=256).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 256 for r in got)
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    want = Counter()
    for r in rows():
        ids = np.array([*enc.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n in packing.piece_lengths(len(ids), 256):
            want[r[0], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want


def test_pack_writes_the_ids(docs, tmp_path):
    """Documents are put together again from the sequences that were written."""
    enc = __import__("tokenizers").Tokenizer.from_file(default_path(WORD_BPE))
    packing.pack(docs.withColumn("part", docs.slot).withColumn("ids", docs.slot), capacity=128).write.parquet(str(tmp_path / "packed"))
    got = docs.sparkSession.read.parquet(str(tmp_path / "packed")).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in got}
    assert all(len(ids[r.sequence_id]) == r.length and r.offset == 0 for r in got)
    once = Counter(r[0] for r in rows())
    for doc_id, text in [(r[0], r[1]) for r in rows() if once[r[0]] == 1]:
        own = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        assert np.concatenate([ids[r.sequence_id] for r in own]).tolist() == [*enc.encode(text or "", add_special_tokens=False).ids, 2]
    assert packing.pack(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_equals_library(name):
    import random

    rng = random.Random(9)
    pool = ["word", "Word", "don't", "it's", "x''s", " ", "  ", "   ", "\n", "\n\n", "\t", "ß", "É", "é", "٣", "²", "½", "Ⅷ", "12", "3.14", "_a_", "--", "日本", "İ", "Σ", "ΟΔΟΣ", " ", " ", "\x1c", "\x85", "​", "<|endoftext|>", "<|", "😀", "😀a", ",", "!!", "'", "'ll", "ﬁ", "Å"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(3000)] + [r[1] or "" for r in rows()]
    enc = Encoder(default_path(name))
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        for t, raw in zip(part, enc.encode(part)):
            assert np.frombuffer(raw, "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_sharding(docs):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == len(rows())
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_sharding_near_equal_with_a_hot_key(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    load = Counter()
    for r in sharding.shard(docs, shards=6).collect():
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.05 * min(load.values())


def test_shard_goes_on_from_a_kept_map(spark, tmp_path):
    """A second call keeps the map; with more shards, and then with more rows and
    a slot that became heavy, the next versions move few rows."""
    path = str(tmp_path / "map")
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    where = lambda df: {(r.doc_id, r.text_crc32): (r.shard, r.map_version) for r in df.collect()}
    one = where(sharding.shard(docs, 6, 512, path))
    assert where(sharding.shard(docs.repartition(7), 6, 512, path)) == one and sharding.versions(spark, path) == [1]
    two = where(sharding.shard(docs, 7, 512, path))
    moved = [k for k in one if one[k][0] != two[k][0]]
    assert {v for _, v in two.values()} == {2} and {s for s, _ in two.values()} == set(range(7)) and len(moved) < 1.3 * 4000 / 7
    hot = docs.unionByName(spark.range(3000).selectExpr("5L as doc_id", "concat('hot ', id) as text"))
    three = where(sharding.shard(hot, 7, 512, path))
    load = Counter()
    for r in sharding.shard(hot.repartition(3), 7, 512, path).collect():
        load[r.shard] += r["size"]
        assert three[r.doc_id, r.text_crc32] == (r.shard, 3)
    assert max(load.values()) < 1.05 * min(load.values()) and sharding.versions(spark, path) == [1, 2, 3]
    assert len([k for k in two if two[k][0] != three[k][0]]) < 4000 / 2
    back = where(sharding.shard(docs, 6, 512, path, version=1))
    assert {v for _, v in back.values()} == {1} and back == one
    with pytest.raises(ValueError):
        sharding.shard(docs, 6, 512, path, version=9)


def test_rebalance_moves_little():
    loads = {(s, 0): 100 + s % 7 for s in range(512)}
    one = sharding.plan_map(loads, {}, 8, 512)
    two = sharding.rebalance(one, loads, 9)
    moved = sum(a[5] != b[5] for a, b in zip(one, two))
    assert {r[0] for r in two} == {2} and {r[5] for r in two} == set(range(9))
    assert moved <= 512 / 9 + 8
    three = sharding.rebalance(two, loads, 8)
    assert {r[5] for r in three} == set(range(8))


def test_empty_tables(empty):
    assert quality.quality(empty).count() == 0 and quality.cleaned(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert jaccard.linked_documents(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0
    uri, places = arrow_store.write_tokens(empty)
    assert arrow_store.read_digests(uri, places).count() == 0
    assert packing.packed_digests(empty).count() == 0 and sharding.shard(empty).count() == 0
    assert SCHEMA


def test_jaccard_ids_with_several_texts(spark):
    t, u, v = (" ".join(f"{k}{i}" for i in range(40)) for k in "tuv")
    data = [(3, t), (5, t), (5, u), (5, None), (6, u), (7, v), (7, v), (None, t + " more"), (None, v + " end"), (None, "x y"), (8, None), (8, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for n, num, den in ((3, 90, 100), (5, 80, 100)):
        got = Counter(map(tuple, jaccard.linked_documents(docs, n, num, den).collect()))
        assert got == brute_components(data, n, num, den)


def test_one_of_each_keeps_every_text(spark):
    """Null and repeated ids: a row of each group of linked texts stays."""
    t, u, v, w = (" ".join(f"{k}{i}" for i in range(40)) for k in "tuvw")
    data = [(3, t), (5, t), (5, u), (5, None), (7, t), (7, v + " end"), (None, v), (None, w), (None, w), (None, ""), (8, None), (8, ""), (9, u + " end")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter(map(tuple, jaccard.one_of_each(docs).collect()))
    blank = [k for k in got if not k[1]]
    assert len(blank) == 1 and blank[0][0] == 8
    assert Counter({k: n for k, n in got.items() if k[1]}) == Counter([(3, t), (5, u), (None, v), (None, w)])
    third = spark.createDataFrame([(i if i % 3 else None, " ".join(f"a{i}b{k}" for k in range(30))) for i in range(30)], "doc_id long, text string")
    assert jaccard.one_of_each(third).count() == 30


def test_a_half_written_map_version_is_no_version(spark, tmp_path):
    """What a lost driver left is passed over, and written over by the next call."""
    path = str(tmp_path / "map")
    small, grown = (spark.range(n).selectExpr("id as doc_id", "repeat('x', cast(id % 9 as int)) as text") for n in (300, 900))
    sharding.shard(small, 4, 64, path).count()
    (tmp_path / "map/version=2/_temporary/0").mkdir(parents=True)
    assert sharding.versions(spark, path) == [1]
    got = sharding.shard(grown, 4, 64, path)
    assert got.count() == 900 and {r.map_version for r in got.select("map_version").distinct().collect()} == {2}
    assert sharding.versions(spark, path) == [1, 2] and not (tmp_path / "map/version=2/_temporary").exists()


def test_pairs_are_named_in_the_first_bucket_they_share():
    import numpy as np
    import pandas as pd

    from cuelight.llm import jaccard

    def task(lists):
        rows = [(key, node, node, 100, np.zeros(4, np.uint64).tobytes(), np.array(keys, np.int64)) for key in (-5, 3, 9) for node, keys in lists.items() if key in keys]
        frame = pd.DataFrame(rows, columns=["key", "node", "label", "n", "sketch", "keys"]).assign(_blocks=1, side=0, ti=0, tj=0)
        return [{*zip(found.a, found.b)} for found in (jaccard._compare(90, 100, float("inf"))(part) for _, part in frame.groupby("key"))]

    everywhere = [-5, 3, 9]
    assert task({1: everywhere, 2: everywhere, 4: everywhere}) == [{(1, 2), (1, 4), (2, 4)}, set(), set()]
    assert task({1: [-5, 9], 2: everywhere, 4: [3, 9]}) == [{(1, 2)}, {(2, 4)}, {(1, 4)}]
