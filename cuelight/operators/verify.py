"""How much of a script was spoken, which take is best, and what a cue's verdict is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelight.functions import text as T

#: Likeness from which two words count as one.
SAME_WORD = 0.82


#: Pairs of words that are looked at together.
PAIRS = 1 << 16
#: Letters without their marks, and marks alone gone.
PLAIN = str.maketrans(*T.accent_table()) | dict.fromkeys(range(0x300, 0x370))


def likest(word: str, left: list[str], same: float = SAME_WORD) -> int | None:
    """Place of the first word of `left` that is most like `word`, if like
    enough. Cheap upper bounds rule most words out before they are compared."""
    if word in left:
        return left.index(word)
    best, place = 0.0, None
    for k, other in enumerate(left):
        if 2 * min(len(word), len(other)) < same * (len(word) + len(other)):
            continue
        m = SequenceMatcher(None, word, other)
        if m.quick_ratio() >= same and (r := m.ratio()) >= same and r > best:
            best, place = r, k
    return place


def match_words(want: list[str], heard: list[str], find: Callable[[str, list[str]], int | None] = likest) -> tuple[float, list[str], list[str]]:
    """Share of wanted words that were heard, the missing ones, and those heard
    with other tones. In order, each word takes the likest word left, if like
    enough, else the first that differs in tone marks only."""
    left, plains = list(heard), [other.translate(PLAIN) for other in heard]
    missing: list[str] = []
    tonal: list[str] = []
    for word in want:
        place = find(word, left)
        if place is None:
            plain = word.translate(PLAIN)
            place = plains.index(plain) if plain in plains else None
            (missing if place is None else tonal).append(word)
        if place is not None:
            del left[place], plains[place]
    return (len(want) - len(missing)) / max(1, len(want)), missing, tonal


def word_pairs(rows: DataFrame, same: float = SAME_WORD) -> DataFrame:
    """id, w, g: of each row (id, want, got) the pairs of a wanted and another
    heard word that may be alike enough: two upper bounds of likeness, by length
    and by letters in common, leave few of them. The bounds are worked out for a
    wanted word and all the row's heard words at once."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str, str]] = []
            for key, left, right in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ws, gs = sorted(set(left or ())), sorted(set(right or ()))
                if not ws or not gs:
                    continue
                cw, cg, nw, ng = letter_counts(ws), letter_counts(gs), np.array([*map(len, ws)]), np.array([*map(len, gs)])
                both = {w: x for x, w in enumerate({*ws, *gs})}  # numbers tell words apart
                aw, ag = np.array([both[w] for w in ws]), np.array([both[g] for g in gs])
                step = max(1, PAIRS // len(gs))
                for at in range(0, len(ws), step):
                    sizes = same * (nw[at : at + step, None] + ng)
                    k, j = np.nonzero((2 * np.minimum(nw[at : at + step, None], ng) >= sizes - 1e-9) & (aw[at : at + step, None] != ag))
                    sizes, k = sizes[k, j], k + at
                    long = nw[k] >= 255  # counts may have been cut
                    close = long | (2 * np.minimum(cw[k], cg[j]).sum(1, dtype=np.uint16) >= sizes - 1e-9)
                    found += [(key, ws[x], gs[y]) for x, y in zip(k[close].tolist(), j[close].tolist())]
            yield pa.record_batch([pa.array([f[k] for f in found], pa.string()) for k in range(3)], names=["id", "w", "g"])

    return rows.select("id", "want", "got").mapInArrow(near, "id string, w string, g string")


def letter_counts(words: list[str]) -> np.ndarray:
    """How often each word has the letters of each of 32 classes: what two words
    have in common by class is no less than by letter. Counts end at 255, which
    only longer words reach; those pass for alike by letters."""
    places = np.repeat(np.arange(len(words)), [*map(len, words)]) * 32
    flat = np.bincount(places + np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % 32, minlength=32 * len(words))
    return np.minimum(flat, 255).astype(np.uint8).reshape(-1, 32)


def alike(pairs: DataFrame, same: float = SAME_WORD) -> DataFrame:
    """The pairs (id, w, g) whose likeness is `same` or more, with it. Equal pairs
    of words of all rows come together, so each likeness is worked out once."""

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, r = None, 0.0
        for batch in batches:
            out = []
            for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if pair != last:
                    m = SequenceMatcher(None, *pair)
                    last, r = pair, m.ratio() if m.quick_ratio() >= same else 0.0
                out.append(r)
            out = np.array(out, float)
            yield batch.append_column("ratio", pa.array(out)).filter(pa.array(out >= same))

    return pairs.repartition("w", "g").sortWithinPartitions("w", "g").mapInArrow(ratio, "id string, w string, g string, ratio double")


def coverage(rows: DataFrame, script: str, heard: str, same: float = SAME_WORD) -> DataFrame:
    """Adds coverage, missing, tonal: what match_words() finds.

    Words are cut by Spark. Likenesses are worked out for distinct pairs of words
    of the whole table and joined back to the texts that need them; the greedy
    pass over a text only looks them up. Equal texts are matched once. Null texts
    have no words."""
    text = F.concat_ws("\x00", F.coalesce(script, F.lit("")), F.coalesce(heard, F.lit("")))
    keyed = rows.withColumn("_text", F.sha2(text, 256))
    base = keyed.select(F.col("_text").alias("id"), T.script_words(F.col(script)).alias("want"), T.script_words(F.col(heard)).alias("got")).dropDuplicates(["id"])
    like = alike(word_pairs(base, same), same).groupBy("id").agg(F.collect_list(F.struct("w", "g", "ratio")).alias("like"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for want, got, pairs in zip(*(batch.column(k).to_pylist() for k in ("want", "got", "like"))):
                near: dict[str, dict[str, float]] = {}
                for p in pairs or ():
                    near.setdefault(p["w"], {})[p["g"]] = p["ratio"]
                out.append(match_words(want, got, lambda w, left: likest_known(w, left, near)))  # noqa: B023
            kinds = (pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.record_batch([batch.column("_id"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], names=["_id", "coverage", "missing", "tonal"])

    # rows rather than a column: fields taken from a function's column would have it run for each of them
    found = base.join(like, "id", "left").select(F.col("id").alias("_id"), "want", "got", "like").mapInArrow(match, "_id string, coverage double, missing array<string>, tonal array<string>")
    out = keyed.join(found, F.col("_text") == F.col("_id"))
    return out.select(*[keyed[c] for c in rows.columns], *[found[c] for c in ("coverage", "missing", "tonal")])


def likest_known(word: str, left: list[str], near: dict[str, dict[str, float]]) -> int | None:
    """As likest(), by known likenesses of a word to others: the first word of the greatest."""
    if word in left:
        return left.index(word)
    best, place = 0.0, None
    for other, r in near.get(word, {}).items():
        if r >= best and other in left:
            k = left.index(other)
            if place is None or r > best or k < place:
                best, place = r, k
    return place


def exact_coverage(rows: DataFrame, script: str, heard: str, key: str) -> DataFrame:
    """The part of coverage that exact words account for: matched and wanted
    words of each key, by counts of equal words on both sides."""
    side = lambda c, n: rows.select(key, F.explode(T.script_words(F.col(c))).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias(n))
    both = side(script, "want").join(side(heard, "got"), [key, "w"], "left")
    return both.groupBy(key).agg(F.sum("want").alias("wanted"), F.sum(F.least("want", F.coalesce("got", F.lit(0)))).alias("matched"))


def heard_text(n_samples: Column, text: Column, rate: int = 24_000) -> Column:
    """Clips under 50 ms aren't transcribed: nothing was heard in them."""
    return F.when(F.coalesce(n_samples, F.lit(0)) < rate // 20, "").otherwise(text)


def best_take(takes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The take of each key that is first in `order`: most words, then most like
    the voice, then the earliest attempt, as the caller lists them."""
    return takes.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def needed_attempts(takes: DataFrame, keys: list[str], done: Column, attempt: str = "attempt") -> DataFrame:
    """Attempts up to and with the first that is good enough: later ones would not be made."""
    rows = takes.withColumn("_first", F.min(F.when(done, F.col(attempt))).over(W.partitionBy(*keys)))
    return rows.where(F.col("_first").isNull() | (F.col(attempt) <= F.col("_first"))).drop("_first")


def verdict(rows: DataFrame, coverage: str = "coverage", clip_ms: str = "clip_ms") -> DataFrame:
    """Adds status, cer and note of a cue from its best take (coverage, clip_ms,
    missing, tonal); a cue without a take, or with an empty one, has failed."""
    cov = F.col(coverage)
    none, silent = cov.isNull(), F.coalesce(F.col(clip_ms), F.lit(0)) <= 0
    tonal, missing = F.array_join(F.col("tonal"), ", "), F.array_join(F.col("missing"), ", ")
    status = F.when(none | silent, "qc_fail").when(cov >= 1, "qc_pass").when(cov >= 0.9, "review").otherwise("qc_fail")
    note = F.when(none, "no take").when(silent, "no audio").when(cov < 1, F.concat(F.lit("missing: "), missing)).when(F.size("tonal") > 0, F.concat(F.lit("tone check: "), tonal))
    return rows.withColumn("status", status).withColumn("cer", F.when(none | silent, 1.0).otherwise(F.bround(1 - cov, 4))).withColumn("note", note)


def take_means(best: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean coverage and likeness over best takes, 0 where there is none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}")
    return best.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("takes"), mean("coverage"), mean("similarity"))


def best_of(*options: Callable[[], str]) -> str:
    """The first option that works; the last one's error if none does."""
    for k, f in enumerate(options):
        try:
            return f()
        except Exception:
            if k + 1 == len(options):
                raise
    raise ValueError("no option")
