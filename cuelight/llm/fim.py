"""Fill in the middle: texts rearranged so that a model learns to fill gaps.

A text is an array of units (runs of letters, single other characters). Two cuts
that follow from a digest of the document's id part it into prefix, middle and
suffix, which are put down in another order with a sentinel before each. All of
it is Spark SQL functions on one row at a time; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
SEED = "1"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of texts that stay plain from here on, and of the others that put the suffix first.
PLAIN_FROM = 90
SUFFIX_FIRST = 20


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits that hang on seed and doc_id only; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def arranged(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output.

    form is plain for texts that are empty, null or hold a sentinel, and for the
    share that is drawn; their output is the text, and the two lengths are null.
    Otherwise psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    Repeated rows are cut alike, as equal ids are; a null id is drawn as an empty
    one. A text is one row's array of units, so an executor needs memory for
    the largest text's units. Empty table: no rows. Other columns aren't read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    rows = rows.withColumn("_u", F.regexp_extract_all("_t", F.lit(UNIT), F.lit(0)))
    # each step is a projection of its own, so that a value used twice is computed once
    h = draws(F.col("doc_id"), seed)
    rows = rows.withColumn("n", F.size("_u").cast("long")).withColumns({"_h1": h[0], "_h2": h[1], "_h3": h[2], "_h4": h[3]})
    rows = rows.withColumns({"_a": F.least(F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)), "_b": F.greatest(F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1))})
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_t", F.lit(mark))
    plain = (F.col("_t") == "") | marked | (F.col("_h3") % 100 >= plain_from)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("_h4") % 100 < suffix_first, "spm").otherwise("psm"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("_u", (start + 1).cast("int"), size.cast("int")), ""))
    rows = rows.withColumns({"_p": part(F.lit(0), F.col("_a")), "_m": part(F.col("_a"), F.col("_b") - F.col("_a")), "_s": part(F.col("_b"), F.col("n") - F.col("_b"))})
    psm = F.concat(F.lit(PREFIX), "_p", F.lit(SUFFIX), "_s", F.lit(MIDDLE), "_m")
    spm = F.concat(F.lit(SUFFIX), "_s", F.lit(PREFIX), "_p", F.lit(MIDDLE), "_m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_t"))
    return rows.select("doc_id", "n", "form", F.length("_p").cast("long").alias("prefix_chars"), F.length("_m").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Sentinels are looked
    for from the left: none is in a part, and none arises where parts meet."""
    def parts(*marks: str) -> list[Column]:
        found, rest = [], F.substring(output, F.lit(len(marks[0]) + 1), F.length(output))
        for mark in marks[1:]:
            head = F.substring_index(rest, mark, 1)
            found.append(head)
            rest = F.substring(rest, F.length(head) + len(mark) + 1, F.length(rest))
        return [*found, rest]

    p, s, m = parts(PREFIX, SUFFIX, MIDDLE)
    psm = F.concat(p, m, s)
    s, p, m = parts(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(p, m, s)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """arranged(), with the sha-256 of the output and of the text restored from it in place of the output."""
    rows = arranged(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle(seed: str = SEED, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> str:
    h = ", ".join(f"('0x' || substr(d, {8 * k + 1}, 8))::bigint h{k + 1}" for k in range(4))
    mark = " or ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{UNIT}') u, sha256('{seed}:' || coalesce(doc_id::varchar, '')) d from documents),
h as (select doc_id, t, u, len(u)::bigint n, {h} from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b, case when t = '' or {mark} or h3 % 100 >= {plain_from} then 'plain' when h4 % 100 < {suffix_first} then 'spm' else 'psm' end form from h),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') p, coalesce(array_to_string(u[a + 1:b], ''), '') m, coalesce(array_to_string(u[b + 1:], ''), '') s from f)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end prefix_chars, case when form <> 'plain' then length(m)::bigint end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end) output_sha256, sha256(t) restored_sha256 from p"""
