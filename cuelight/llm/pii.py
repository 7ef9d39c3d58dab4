"""Personal data: four base patterns, and spans that a trained tagger adds.

The base patterns are matched leftmost and without overlaps, in linear time. The
tagger reads overlapping windows on a fixed grid, wherever a digit, an at sign or
one of its spellings is: no span of these kinds is without one. Its spans are
pooled over a text's windows, halves that windows cut are joined, and the best
set without overlaps is chosen for the whole text; spans that are none of their
kind (a card fails its check digit, an address has no host), or that touch a base
span, are dropped. Base spans always stay. What the tagger adds are numbers in
groups of other shapes, and addresses that are spelled ('jo [at] post [dot] org').
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm import tagger
from cuelight.llm.common import own_worker
from cuelight.llm.tagger import KINDS, WINDOW

STRIDE = WINDOW // 2
BATCH = 256
#: Least mean probability of a span's characters.
SURE = 0.75

Span = tuple[int, int, str]

RUN_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]|\bdot\b", re.I)
SPELLED_AT = re.compile(r"\s*(?:@|[(\[]at[)\]]|(?<=\s)at(?=\s))\s*", re.I)
SPELLED_DOT = re.compile(r"\s*(?:[(\[]dot[)\]]|(?<=\s)dot(?=\s))\s*", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_DOT = re.compile(r" ?(?:\.|[(\[]\.[)\]]) ?")
GROUPED = re.compile(r"[0-9]+(?:[ ./_-]{1,3}[0-9]+)*")
DIALLED = re.compile(r"[+(]{0,2}[0-9]+(?:[ ()./-]{1,3}[0-9]+)*")
WORD = re.compile(r"\S+")
NOT_DIGIT = re.compile(r"[^0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then by kind in the order of KINDS."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:  # what an address needs before its sign is the run of local characters there
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        m = HOST.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        d = NOT_DIGIT.sub("", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def plausible(text: str, span: Span) -> bool:
    """Is what the tagger found of its kind? Its form is left to the tagger."""
    a, b, kind = span
    s = text[a:b]
    if text[a - 1 : a].isalnum() or text[b : b + 1].isalnum() or "\n" in s:
        return False
    if kind == "email":
        return ADDRESS.fullmatch(SPELLED_DOT.sub(".", SPELLED_AT.sub("@", s, count=1))) is not None
    if kind == "ip":
        parts = IP_DOT.split(s)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    d = NOT_DIGIT.sub("", s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and GROUPED.fullmatch(s) is not None
    return 9 <= len(d) <= 15 and DIALLED.fullmatch(s) is not None


def fitted(text: str, span: Span) -> Span | None:
    """The span, or what is plausible of it without a few words at its beginning
    or end: where an address is written with blanks, its bounds are the hardest part."""
    a, b, kind = span
    words = [m.span() for m in WORD.finditer(text, a, b)]
    starts, ends = [a, *(s for s, _ in words[1:4])], [b, *(e for _, e in words[-2:-5:-1])]
    cuts = sorted(((s, e) for s in starts for e in ends if s < e), key=lambda x: (a - x[0]) + (x[1] - b), reverse=True)
    return next(((s, e, kind) for s, e in cuts if plausible(text, (s, e, kind))), None)


def window_starts(text: str) -> list[int]:
    """Starts, on the grid of STRIDE, of the windows that hold a trigger."""
    at = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        at.add(k)
        at.add(max(0, k - 1))
    return [k * STRIDE for k in sorted(at)]


def window_spans(tags: np.ndarray, sure: np.ndarray, size: int) -> list[tuple[int, int, str, float]]:
    out, t = [], 0
    while t < size:
        if tags[t] % 2 == 1:
            e = t + 1
            while e < size and tags[e] == tags[t] + 1:
                e += 1
            out.append((t, e, KINDS[(tags[t] - 1) // 2], float(sure[t:e].mean())))
            t = e
        else:
            t += 1
    return out


def reconcile(text: str, found: list[tuple[int, int, str, float, bool]], base: list[Span]) -> list[Span]:
    """One set of spans for the text from those of its windows (start, end,
    kind, sureness, cut by the window's edge?). Overlapping spans of a kind are
    joined when one is cut; then the set without overlaps of the greatest summed
    length times sureness is chosen."""
    pooled: list[list] = []
    for a, b, kind, sure, cut in sorted(found):
        old = next((p for p in pooled[-4:] if p[2] == kind and a < p[1] and (cut or p[4])), None)
        if old:
            whole = [x for x in ((old[0], old[1], old[3], old[4]), (a, b, sure, cut)) if not x[3]]
            if whole:  # one window saw it whole
                best = max(whole, key=lambda x: x[1] - x[0])
                old[0], old[1], old[3], old[4] = best
            else:
                old[0], old[1], old[3] = min(a, old[0]), max(b, old[1]), min(sure, old[3])
        else:
            pooled.append([a, b, kind, sure, cut])
    ok = [(*s, p[3]) for p in pooled if p[3] >= SURE and (s := fitted(text, (p[0], p[1], p[2]))) is not None]
    ok = [p for p in ok if not any(a < p[1] and p[0] < b for a, b, _ in base)]
    ok = sorted(set(ok), key=lambda p: (p[1], p[0], p[2]))
    ends = [p[1] for p in ok]
    back: list[tuple[int, bool]] = []
    value = [0.0]
    for i, (a, b, _, sure) in enumerate(ok):
        j = bisect.bisect_right(ends, a, 0, i)
        take = value[j] + (b - a) * sure
        back.append((j, take > value[i]))
        value.append(max(value[i], take))
    out, i = [], len(ok)
    while i:
        j, took = back[i - 1]
        if took:
            out.append(ok[i - 1][:3])
            i = j
        else:
            i -= 1
    return out[::-1]


def all_spans(texts: list[str], model: dict) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) of each text; the windows of all texts share batches."""
    own_worker("pii", dict)
    base = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    jobs = []

    def run() -> None:
        ids = np.zeros((len(jobs), WINDOW), np.int64)
        for r, (_, _, s, _) in enumerate(jobs):
            ids[r, : len(s)] = s
        tags, sure = tagger.decode(model, ids)
        for r, (i, at, s, more) in enumerate(jobs):
            for a, b, kind, p in window_spans(tags[r], sure[r], len(s)):
                found[i].append((at + a, at + b, kind, p, a == 0 and at > 0 or b == len(s) and more))
        jobs.clear()

    for i, t in enumerate(texts):
        starts = window_starts(t)
        if not starts:
            continue
        s = tagger.symbols(t)
        for at in starts:
            jobs.append((i, at, s[at : at + WINDOW], at + WINDOW < len(s)))
            if len(jobs) == BATCH:
                run()
    if jobs:
        run()
    return [(b, ordered(b + reconcile(t, f, b))) if f else (b, b) for t, f, b in zip(texts, found, base)]


def digest(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind; overlapping spans become one."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def private_spans(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans
    (base ones and those the tagger adds) for every row.

    Null and empty texts: no spans. Repeated rows: the same spans. Very long
    texts are read whole, window by window. Ties between the tagger's spans go to
    the earlier one. Empty table: no rows. Other columns of docs are not read.
    """
    model = model or tagger.default_model()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = all_spans([t or "" for t in batch.column("text").to_pylist()], model)
            counts = [pa.array([sum(s[2] == kind for s in b) for b, _ in got], pa.int64()) for kind in KINDS]
            sha = pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in got], pa.string())
            yield pa.record_batch([batch.column("doc_id"), *counts, sha, pa.array([digest(s) for _, s in got], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with their own columns and the spans in text replaced by <KIND>;
    n_chars, where there is one, follows. A null text stays null, an empty one
    empty; repeated rows are treated alike. Empty table: no rows. Columns of any
    names are carried along."""
    model = model or tagger.default_model()
    own = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            got = all_spans([t or "" for t in texts], model)
            new = pa.array([None if t is None else redact(t, s) for t, (_, s) in zip(texts, got)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], names=own)

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in own else out
