"""Mixing sources to target weights by Pareto order sampling.

Every document of a source gets the whole copies that are certain; what is left
of the source's target is drawn without replacement, with odds of inclusion that
rise with a document's size (probability proportional to size). Documents rank
by their random odds over their inclusion odds; the ranking is cut where the
words drawn come nearest to what is left, so the sample's size is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelight.llm.common import small, staged, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Cells of one level of the search for the cut; three levels leave one unit in 7e10 to a cell.
CELLS = 4096

UP_TO = (W.unboundedPreceding, -1)


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def source_targets(base: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target. The rise of all targets by weight stops for
    a source at `most` times its size; sorted by that point, the level follows
    from running sums. One row a source, so the plain window holds few rows."""
    s = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = s.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(*UP_TO), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    s = s.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    free = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(all_rows)["level"]
    return s.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * free).alias("target"))


def with_rate(base: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds whole (certain copies), rest (words still to draw) and rate: a
    document of n words is drawn with probability min(1, rate * n), and the
    expected words are the rest. Solved on counts of equal sizes: those above
    the rate's reach are certain, and the first consistent cut is the one."""
    t = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("int"))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    h = base.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n"))
    down = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(*UP_TO)
    rest_of = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(0, W.unboundedFollowing)
    h = h.select("source", "size", F.coalesce(F.sum(F.col("_n") * F.col("size")).over(down), F.lit(0)).alias("_sure"), F.sum((F.col("_n") * F.col("size") * F.col("size")).cast("double")).over(rest_of).alias("_square"))
    h = h.withColumnRenamed("source", "_s").join(t, F.col("_s").eqNullSafe(F.col("source"))).withColumn("rate", (F.col("rest") - F.col("_sure")) / F.col("_square"))
    h = h.where(F.col("rate") * F.col("size") <= 1).groupBy(F.col("_s")).agg(F.max_by("rate", "size").alias("rate"))
    return t.join(h, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", "rest", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def order_key(seed: str = SEED) -> Column:
    """Random odds over inclusion odds; null where nothing can be drawn. The
    random number is 52 bits of the md5 of seed and doc_id, so reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / float(1 << 52)
    p = F.least(F.lit(1.0), F.col("rate") * F.col("size"))
    return F.when(p > 0, F.when(p >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p))))


def _with_cells(rows: DataFrame) -> DataFrame:
    v = F.col("_key") / (1 + F.col("_key")) * CELLS
    rows = rows.withColumn("_c1", F.least(F.floor(v), F.lit(CELLS - 1)))
    rows = rows.withColumn("_r1", (v - F.col("_c1")) * CELLS).withColumn("_c2", F.least(F.floor("_r1"), F.lit(CELLS - 1)))
    return rows.withColumn("_c3", F.least(F.floor((F.col("_r1") - F.col("_c2")) * CELLS), F.lit(CELLS - 1))).drop("_r1")


def _boundary(rows: DataFrame, by: list[str]) -> DataFrame:
    """For each source the first group of `by` whose words, with those before
    (`_before` counts the words of cells passed already), reach the rest."""
    g = rows.groupBy("source", *by).agg(F.sum("size").alias("_words"), F.first("_before").alias("_base"), F.first("rest").alias("rest"))
    run = F.col("_base") + F.coalesce(F.sum("_words").over(W.partitionBy("source").orderBy(*by).rowsBetween(*UP_TO)), F.lit(0))
    g = g.withColumn("_before", run).where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_words") >= F.col("rest")))
    return g.select(F.col("source").alias("_s"), *[F.col(c).alias(f"_b{c}") for c in by], F.col("_before").alias("_b_before"), F.col("_words").alias("_b_words"), F.col("rest").alias("_b_rest"))


def mixing_plan(base: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row a source: its target, whole copies, rate, and the unit of the
    ranking where the draw ends (cut_*; cut_in: is that unit drawn itself?).

    base: doc_id, source, size, staged. The cut is found by sums over cells of
    the ranking, then over cells of the cell it falls in, so that no task sorts
    a source; only the units of one cell in CELLS ** 3 meet in a window.
    """
    plan = staged(with_rate(base, source_targets(base, weights, share, most)), "mix-plan")
    rows = base.join(small(plan.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_key", order_key(seed))
    rows = _with_cells(rows.where("_key is not null and rest > 0").select("source", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), "size", "rest", "_key", F.lit(0).cast("long").alias("_before")))
    rows = staged(rows, "mix-keys")
    for cell in ("_c1", "_c2", "_c3"):
        edge = small(staged(_boundary(rows, [cell]), "mix-cell"))
        rows = rows.drop("_before").join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col(cell) == F.col(f"_b{cell}"))).select("source", "_doc", "size", "rest", "_key", "_c1", "_c2", "_c3", F.col("_b_before").alias("_before"))
    cut = _boundary(rows, ["_key", "_doc", "size"])
    cut = cut.select("_s", F.col("_b_key").alias("cut_key"), F.col("_b_doc").alias("cut_doc"), F.col("_bsize").alias("cut_size"), (F.col("_b_rest") - F.col("_b_before") > F.col("_b_words") / 2).alias("cut_in"))
    return staged(plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-cut")


def with_copies(sized: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and copies (whole ones and the drawn one) to
    rows that have doc_id, source and size."""
    rows = sized.join(small(plan.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_key", order_key(seed))
    at, cut = F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("size").alias("n")), F.struct(F.col("cut_key").alias("_key"), F.col("cut_doc").alias("d"), F.col("cut_size").alias("n"))
    drawn = F.col("_key").isNotNull() & F.col("cut_key").isNotNull() & ((at < cut) | ((at == cut) & F.col("cut_in")))
    return rows.withColumn("copies", F.col("whole") + F.coalesce(drawn, F.lit(False)).cast("int")).drop("_s", "_key", "whole", "rest", "rate", "cut_key", "cut_doc", "cut_size", "cut_in")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size (words), source_size, target, taken, copies for every row.

    Taken words of a source end within half a document of its target. Null
    text: size 0, nothing taken. Null source: a source of its own, the last.
    Rows that share doc_id and size in a source are one unit of the draw: all
    or none. Null doc_ids are one such id. Empty table: no rows. Other columns
    of docs are not read.
    """
    base = staged(sizes(docs), "mix-sizes")
    out = with_copies(base, mixing_plan(base, weights, share, most, seed), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, with its
    own columns. The ranking needs only sizes, so texts are never shuffled."""
    plan = mixing_plan(staged(sizes(docs), "mix-sizes"), weights, share, most, seed)
    own = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = with_copies(rows, plan, seed).where("copies > 0")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[F.col("_row")[c].alias(c) for c in own])


def oracle(weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> str:
    """The whole draw in DuckDB SQL."""
    w = "[" + ", ".join(map(str, weights)) + "]"
    return rf"""
with recursive base as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint source_size, {w}[((row_number() over (order by source nulls last) - 1) % {len(weights)})::int + 1] w from base group by source),
t as (select *, {most} * source_size cap from s),
l as (select *, ({share} * sum(source_size) over () - coalesce(sum(cap) over o, 0))::double / (sum(w) over () - coalesce(sum(w) over o, 0)) as level
      from t window o as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, cap <= w * level as is_full from l),
g as (select source, source_size, case when is_full then cap::double else w * (select arg_min(level, cap / w) from f where not is_full) end target from f),
p as (select *, case when source_size > 0 then floor(target / source_size)::int else 0 end whole from g),
r as (select *, target - whole * source_size rest from p),
h as (select source, size, count(*) n from base where size > 0 group by all),
k as (select source, size, coalesce(sum(n * size) over d, 0)::double sure, sum((n * size * size)::double) over e square from h
      window d as (partition by source order by size desc rows between unbounded preceding and 1 preceding),
             e as (partition by source order by size desc rows between current row and unbounded following)),
q as (select k.source, arg_max((rest - sure) / square, size) rate from k join r on k.source is not distinct from r.source where (rest - sure) / square * size <= 1 group by k.source),
d as (select b.doc_id, b.size, r.*, least(1.0::double, coalesce(rate, 0) * b.size) pr,
        (('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / {float(1 << 52)} u
      from base b join r on b.source is not distinct from r.source left join q on b.source is not distinct from q.source),
o as (select *, case when pr >= 1 then 0.0::double when pr > 0 then (u / (1 - u)) / (pr / (1 - pr)) end key from d),
unit as (select source, key, coalesce(doc_id, -9223372036854775808) doc, size, sum(size)::bigint words, any_value(rest) rest from o where key is not null and rest > 0 group by all),
cum as (select *, coalesce(sum(words) over (partition by source order by key, doc, size rows between unbounded preceding and 1 preceding), 0)::double before from unit),
took as (select source, key, doc, size from cum where rest - before > words / 2)
select o.doc_id, o.size, o.source_size, o.target, ((o.whole + (took.doc is not null)::int) * o.size)::bigint taken, (o.whole + (took.doc is not null)::int)::int copies
from o left join took on o.source is not distinct from took.source and o.key = took.key and coalesce(o.doc_id, -9223372036854775808) = took.doc and o.size = took.size"""
