"""Small tables with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, size string, copies int"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Über", "naïve", "x1", "42", "omega,", "pi."]) + str(rng.randrange(60)) for _ in range(n))


def rows(seed=3, count=40):
    """Random texts, nulls in every column, empty and blank texts, a very long
    text, exact and near copies, repeated rows, and columns of clashing names."""
    rng = random.Random(seed)
    out = []
    base = sentence(rng, 120)
    for i in range(count):
        t = "\n".join(sentence(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6)))
        if i % 9 == 0:
            t = base
        elif i % 9 == 1:
            w = base.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 9 == 2:
            t = "Shared line of the host\n" + t + "\nShared line of the host"
        out.append((i, t, "en", f"s{i % 3}", len(t)))
    out += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n ", "en", "s1", 4), (None, "a text without an id " * 20, "en", None, None), (None, None, None, None, None)]
    out += [(103, sentence(rng, 6000), "en", "s2", None), (104, "one", "en", "s2", 3), (105, "İstanbul ΣΑΣ  three   spaces\x1f<|endoftext|>   end ", "tr", "s0", 9)]
    out += [out[0], out[0], out[5]]
    return [(*r, "x", "y", 7) for r in out]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)
