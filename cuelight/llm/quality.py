"""Quality rules: base statistics, and lines that too many documents of a host share.

Lines are normalised and hashed; the distinct documents of each host that hold a
line are counted; lines above the limit are boilerplate and are removed, and a
document that loses most of its words with them is rejected. Copies are not what
makes a line boilerplate: documents are told apart by the least hash of their
5-word windows, which exact copies share, and near copies for the most part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import scratch, staged, word_count, words

#: A line is boilerplate in over SHARE of its host's documents, and over LEAST.
SHARE = 0.02
LEAST = 4
#: A document is depleted when under KEEP of its words lie in other lines.
KEEP = 0.3
MIN_WORDS = 50
MAX_REPEAT = 0.5
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_line(line: Column) -> Column:
    """Lower case, digits alike, white space runs as one space, trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    """128 bits, as two longs: no two lines of a corpus are taken for one."""
    return let(normal_line(line), lambda n: F.struct(F.xxhash64(n).alias("a"), F.xxhash64(n, F.lit(1)).alias("b")))


def text_lines(text: Column) -> Column:
    """The lines of text with a word; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")


def copy_mark(text: Column) -> Column:
    """The least md5 of the 5-word windows of a text, of all its words where they
    are fewer; 8 bytes of it. Null for null."""
    def least(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0)))
        return F.array_min(F.transform(at, lambda i: F.md5(F.concat_ws(" ", *[F.get(w, i + k) for k in range(5)]))))

    return F.when(text.isNotNull(), F.unhex(F.substring(let(words(text), least), 1, 16)))


def frequent_lines(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host, lines: the hashes above the host's limit. Texts of one copy_mark are
    one document of a host here, and null texts are none. The counts are summed
    before and after one shuffle by host, line and mark, which deals a line that
    all documents hold over all tasks."""
    base = docs.where("text is not null").select(F.col("source").cast("string").alias("_host"), copy_mark(F.col("text")).alias("_mark"), F.array_distinct(F.transform(text_lines(F.col("text")), line_hash)).alias("_lines"))
    marked = staged(base.select("_host", "_mark", F.explode_outer("_lines").alias("_line")).distinct(), "host-lines")
    counts = marked.where("_line is not null").groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    hosts = marked.groupBy(F.col("_host").alias("_h"), "_mark").agg(F.lit(1)).groupBy("_h").agg(F.count(F.lit(1)).alias("_docs"))
    over = counts.where(F.col("_n") > least).join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).where(F.col("_n") > share * F.col("_docs"))
    return over.groupBy("_host").agg(F.collect_list("_line").alias("_frequent"))


def window_hashes(w: Column) -> Column:
    """Hashes of the 3-word windows of a list with their places, sorted."""
    at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))


def covered(hashed: Column) -> Column:
    """Words in windows found twice or more: places whose hash has an equal
    neighbour are the repeated ones, and each adds up to 3 words not covered yet."""
    same = F.filter(hashed, lambda x, i: (F.get(hashed, i - 1)["h"] == x["h"]) | (F.get(hashed, i + 1)["h"] == x["h"]))
    places = F.sort_array(F.transform(same, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def _measured(docs: DataFrame, min_words: int, max_repeat: float) -> DataFrame:
    """Adds _q, a struct of the base statistics, and _base_failed to docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), let(window_hashes(w), covered).alias("repeated")))
    dup_lines = let(text_lines(F.col("text")), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    rows = docs.withColumn("_w", of_words)
    rows = rows.withColumn("_q", F.struct(
        F.col("_w.n").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines.alias("n_dup_lines"),
        F.col("_w.repeated").alias("n_repeat_words"))).drop("_w")
    q = F.col("_q")
    return rows.withColumn("_base_failed", (q["n_words"] < min_words) | (q["n_repeat_words"] > max_repeat * q["n_words"]))


def _judged(docs: DataFrame, share: float, least: int, keep: float, min_words: int, max_repeat: float) -> DataFrame:
    """Adds _q, _base_failed, _frequent, _left (words outside frequent lines)
    and _kept. Few lines can be above a host's limit, so the table of hosts is
    small; its files' size decides whether Spark broadcasts it."""
    with scratch() as hold:
        frequent = hold(staged(frequent_lines(docs, share, least), "frequent-lines"))
    rows = docs.withColumn("_hk", F.col("source").cast("string")).join(frequent, F.col("_hk").eqNullSafe(F.col("_host")), "left").drop("_host", "_hk")
    rows = _measured(rows, min_words, max_repeat)
    lost = F.when(F.col("_frequent").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(
        F.filter(text_lines(F.col("text")), lambda x: F.array_contains(F.col("_frequent"), line_hash(x))), F.lit(0).cast("long"), lambda acc, x: acc + word_count(x)))
    rows = rows.withColumn("_left", F.col("_q")["n_words"] - lost)
    return rows.withColumn("_kept", ~F.col("_base_failed") & (F.col("_left") >= keep * F.col("_q")["n_words"]))


def quality(docs: DataFrame, share: float = SHARE, least: int = LEAST, keep: float = KEEP, min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, left_words for every row.

    Null and empty texts have no words and fail the base rules; null texts are no
    documents of their host. A null source is a host of its own. Repeated rows
    are equal texts: each is judged, and they count once for their lines. Ties:
    a line at the limit stays. Very long texts are read whole. Empty table: no
    rows. Other columns of docs are not read.
    """
    rows = _judged(docs.select("doc_id", "text", "source"), share, least, keep, min_words, max_repeat)
    q = F.col("_q")
    return rows.select("doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_left").alias("left_words"))


def cleaned(docs: DataFrame, share: float = SHARE, least: int = LEAST, keep: float = KEEP, min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """The rows of docs that are kept, with their own columns: frequent lines
    are taken out of text, and n_chars, where there is one, follows. Nulls, empty
    texts, repeated rows and empty tables as in quality(): null and empty texts
    are not kept, each row of several alike is. Columns of any names are carried."""
    own = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("_row"), "doc_id", "text", "source")
    rows = _judged(rows, share, least, keep, min_words, max_repeat)
    # a numbered row holds the filter above the statistics, which it would else compute once more
    rows = rows.withColumn("_seq", F.monotonically_increasing_id()).where("_kept and _seq >= 0")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("_frequent"), line_hash(x))), "\n")
    rows = rows.select("_row", F.when(F.col("_frequent").isNull() | (F.col("_left") == F.col("_q")["n_words"]), F.col("text")).otherwise(rest).alias("_text"))
    kind = dict(docs.dtypes)
    put = {"text": F.col("_text"), "n_chars": F.length("_text").cast(kind.get("n_chars", "long"))}
    return rows.select(*[put.get(c, F.col("_row")[c]).alias(c) for c in own])


def oracle(share: float = SHARE, least: int = LEAST, keep: float = KEEP, min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT) -> str:
    return rf"""
with d as (select row_number() over () as id, doc_id, source, text, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
ln as (select id, source, text, x, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) norm,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) n
       from (select id, source, text, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\x20\x09-\x0D]')),
mark as (select id, min(md5(g)) mark from (select id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d where text is not null) group by id),
hosts as (select source, count(distinct mark) docs from d join mark using (id) group by source),
cnt as (select source, norm, count(distinct mark) docs from ln join mark using (id) group by source, norm),
freq as (select cnt.source, norm from cnt join hosts on cnt.source is not distinct from hosts.source where cnt.docs > {least} and cnt.docs > {share} * hosts.docs),
lost as (select id, sum(n) lost from ln join freq on ln.source is not distinct from freq.source and ln.norm = freq.norm group by id),
dup as (select id, count(*) - count(distinct x) n from ln group by id),
win as (select id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select id, w, unnest(range(1, len(w) - 1)) i from d)),
rep as (select id, i from win qualify count(*) over (partition by id, g) > 1),
cov as (select id, count(distinct p) n from (select id, unnest([i, i + 1, i + 2]) p from rep) group by id),
b as (select d.*, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
        coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words, (len(w) - coalesce(lost.lost, 0))::bigint left_words
      from d left join dup using (id) left join cov using (id) left join lost using (id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {min_words} or n_repeat_words > {max_repeat} * n_words) base_failed,
       not (n_words < {min_words} or n_repeat_words > {max_repeat} * n_words) and left_words >= {keep} * n_words as kept, left_words from b"""
