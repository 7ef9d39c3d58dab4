"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Each character is a symbol (digits but 0 are one, letters lose their case); both
directions' states give a score per tag, and the CRF's transitions make the tags
of a window one sequence. Training follows the exact gradient of the sequence's
likelihood with Adam. Parameters are a dict of small float32 arrays, so a model
travels in a task's closure.

`python -m cuelight.llm.tagger` trains the default model and writes its
parameters beside this file with the settings they were trained under; with
other settings, or without the file, it is trained where it is first needed.
"""

from __future__ import annotations

import io
import pkgutil
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Parameters of the default model, beside this file.
FILE = "tagger_params.npz"

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EMBED, HIDDEN = 16, 32
WINDOW = 96
LETTERS, MARKS = "abcdefghijklmnopqrstuvwxyz", " \n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PAD, OTHER, DIGIT, WORDLIKE, ZERO = 0, 1, 2, 3, 4
SYMBOLS = 5 + len(LETTERS) + len(MARKS)


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x3000; those above are like letters."""
    t = np.full(0x3000, OTHER, np.int64)
    for c in range(len(t)):
        if chr(c).isalpha():
            t[c] = WORDLIKE
    for c in range(48, 58):
        t[c] = DIGIT if c > 48 else ZERO
    for k, c in enumerate(LETTERS):
        t[ord(c)] = t[ord(c.upper())] = 5 + k
    for k, c in enumerate(MARKS):
        t[ord(c)] = 5 + len(LETTERS) + k
    t[[9, 11, 12, 13]] = t[32]
    return t


_table = symbol_table()


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_table), _table[np.minimum(points, len(_table) - 1)], WORDLIKE)


def allowed() -> np.ndarray:
    """0 where tag j may follow tag i, else a large negative number: inside
    follows begin or inside of its own kind."""
    ok = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = -1e4
        ok[inside - 1, inside] = ok[inside, inside] = 0
    return ok


def new_params(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {
        "embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)),
        "wx": rng.normal(0, EMBED**-0.5, (2, EMBED, 4 * HIDDEN)),
        "wh": rng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)) * 0.7,
        "b": np.tile(np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]), (2, 1)),
        "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)),
        "bias": np.zeros(TAGS),
        "trans": np.zeros((TAGS, TAGS)),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
    """States (direction, time, batch, hidden) of x (direction, time, batch, embed),
    and what the gradient needs. Both directions take a step at once."""
    D, T, B, _ = x.shape
    pre = (x.reshape(D, T * B, -1) @ wx).reshape(D, T, B, -1) + b[:, None, None]
    h, c = np.zeros((D, B, HIDDEN), np.float32), np.zeros((D, B, HIDDEN), np.float32)
    hs, cs, gates = (np.empty((T, D, B, n), np.float32) for n in (HIDDEN, HIDDEN, 4 * HIDDEN))
    for t in range(T):
        z = pre[:, t] + h @ wh
        g = gates[t]
        g[..., : 3 * HIDDEN] = _sigmoid(z[..., : 3 * HIDDEN])
        g[..., 3 * HIDDEN :] = np.tanh(z[..., 3 * HIDDEN :])
        c = g[..., HIDDEN : 2 * HIDDEN] * c + g[..., :HIDDEN] * g[..., 3 * HIDDEN :]
        h = g[..., 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
        hs[t], cs[t] = h, c
    return hs.transpose(1, 0, 2, 3), (x, hs, cs, gates)


def lstm_grad(dh_all: np.ndarray, kept, wx: np.ndarray, wh: np.ndarray):
    x, hs, cs, gates = kept
    D, T, B, _ = x.shape
    dz_all = np.empty_like(gates)
    dh, dc = np.zeros((D, B, HIDDEN), np.float32), np.zeros((D, B, HIDDEN), np.float32)
    back = wh.transpose(0, 2, 1)
    for t in range(T - 1, -1, -1):
        dh = dh + dh_all[:, t]
        i, f, o, g = (gates[t][..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        tc = np.tanh(cs[t])
        dc = dc + dh * o * (1 - tc * tc)
        before = cs[t - 1] if t else np.zeros_like(dc)
        dz = dz_all[t]
        dz[..., :HIDDEN] = dc * g * i * (1 - i)
        dz[..., HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
        dz[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        dz[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
        dc = dc * f
        dh = dz @ back
    dz = dz_all.transpose(1, 0, 2, 3).reshape(D, T * B, -1)
    states = hs.transpose(1, 0, 2, 3)[:, :-1].reshape(D, (T - 1) * B, -1)
    dwh = states.transpose(0, 2, 1) @ dz[:, B:]
    return (dz @ wx.transpose(0, 2, 1)).reshape(x.shape), x.reshape(D, T * B, -1).transpose(0, 2, 1) @ dz, dwh, dz.sum(1)


def emissions(p: dict, ids: np.ndarray):
    """Tag scores (time, batch, tags) of windows ids (batch, time)."""
    x = p["embed"][ids.T]
    states, kept = lstm(np.stack([x, x[::-1]]), p["wx"], p["wh"], p["b"])
    both = np.concatenate([states[0], states[1][::-1]], axis=2)
    return both @ p["out"] + p["bias"], (both, kept)


def forward_backward(em: np.ndarray, trans: np.ndarray):
    """log alpha, log beta (time, batch, tags) and log Z (batch). Sums over the
    tag before or after are matrix products of numbers scaled to at most 1."""
    T = len(em)
    step = np.exp(trans)
    a, b = np.empty_like(em), np.zeros_like(em)
    a[0] = em[0] + allowed()[0]  # a window can't begin inside

    def summed(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        top = x.max(axis=1, keepdims=True)
        return top + np.log(np.maximum(np.exp(x - top) @ by, 1e-30))

    for t in range(1, T):
        a[t] = em[t] + summed(a[t - 1], step)
    for t in range(T - 2, -1, -1):
        b[t] = summed(em[t + 1] + b[t + 1], step.T)
    top = a[-1].max(axis=1, keepdims=True)
    return a, b, (top + np.log(np.exp(a[-1] - top).sum(axis=1, keepdims=True)))[:, 0]


def viterbi(em: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (batch, time)."""
    T, B, _ = em.shape
    score, back = em[0] + allowed()[0], np.empty(em.shape, np.int8)
    for t in range(1, T):
        s = score[:, :, None] + trans
        back[t] = s.argmax(1)
        score = s.max(1) + em[t]
    out = np.empty((B, T), np.int64)
    out[:, -1] = score.argmax(1)
    for t in range(T - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(B), out[:, t]]
    return out


def loss_grad(p: dict, ids: np.ndarray, tags: np.ndarray):
    """Mean negative log-likelihood of the tags (batch, time), and its gradient."""
    em, (both, kept) = emissions(p, ids)
    trans = p["trans"] + allowed()
    T, B, _ = em.shape
    a, b, z = forward_backward(em, trans)
    gold = tags.T
    at = np.arange(B)
    score = em[np.arange(T)[:, None], at, gold].sum(0) + trans[gold[:-1], gold[1:]].sum(0)
    d_em = np.exp(a + b - z[:, None])
    d_em[np.arange(T)[:, None], at, gold] -= 1
    top = a[:-1].max(axis=2, keepdims=True)
    left = np.exp(a[:-1] - top).reshape(-1, TAGS)
    right = np.exp(np.minimum((em + b)[1:] + top - z[:, None], 80)).reshape(-1, TAGS)
    pair = np.exp(trans) * (left.T @ right)
    np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    d_em /= B
    g = {"trans": pair / B, "bias": d_em.sum((0, 1)), "out": both.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, TAGS)}
    d_both = d_em @ p["out"].T
    dx, g["wx"], g["wh"], g["b"] = lstm_grad(np.stack([d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]]), kept, p["wx"], p["wh"])
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], ids.T.ravel(), (dx[0] + dx[1][::-1]).reshape(-1, EMBED))
    return float((z - score).mean()), g


def fit(ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 96, rate: float = 0.02, seed: int = 1) -> dict[str, np.ndarray]:
    """Adam over random batches of labelled windows (rows of ids and tags)."""
    rng = np.random.default_rng(seed)
    p = new_params(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(ids), batch)
        _, g = loss_grad(p, ids[rows], tags[rows])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        lr = rate * min(1.0, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k in p:
            x = (g[k] * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def decode(p: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (batch, time) and the probability of each under the model."""
    em, _ = emissions(p, ids)
    trans = p["trans"] + allowed()
    tags = viterbi(em, trans)
    a, b, z = forward_backward(em, trans)
    sure = np.exp(np.minimum(a + b - z[:, None], 0))
    return tags, np.take_along_axis(sure.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0]


#: Labelled windows made for training, and the steps over them: a fixed bound.
EXAMPLES, STEPS, SEED = 30_000, 3600, 7

# Ways to write an address, syllables of made-up words, what numbers are of.
AT = ("@", "@", "@", " @ ", "@ ", " at ", " at ", "(at)", "(at)", " (at) ", "[at]", "[at]", " [at] ")
DOT = {"(at)": ("(dot)", ".", " (dot) "), " (at) ": (" (dot) ", ".", " dot "), "[at]": ("[dot]", "."), " [at] ": (" [dot] ", ".", " dot "), " at ": (" dot ",)}
NAMES = "jane john mary peter anna karl lucia omar wei nina doe smith meyer lopez rossi novak kim info sales office contact".split()
CALLED = ("Phone: ", "phone ", "Tel. ", "Tel: ", "tel ", "Call ", "call me at ", "Fax: ", "Mobile: ", "Mobil ", "Telefon: ", "Tél. ", "cell ", "office: ", "reach us on ", "Hotline ", "T: ")
AMOUNTS = ("Population ", "total of ", "results ", "about ", "No. ", "Order ", "EUR ", "USD ", "$", "pop. ", "sum: ", "ID ", "serial ", "IBAN DE89 ", "votes: ", "in all ", "area ", "row ", "account ", "Ref. ")
PARTS = "an en in on er re th st ou le la de ge sch ver un ci os ar ti ra lo ma ne po ku vi ha so mi".split()


def _word(rng) -> str:
    w = "".join(PARTS[k] for k in rng.integers(0, len(PARTS), rng.integers(1, 5)))
    return w.upper() if rng.random() < 0.05 else w.capitalize() if rng.random() < 0.2 else w


def _pick(rng, options) -> str:
    return options[rng.integers(len(options))]


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng) -> str:
    """A number that passes the check digit, whole or in groups."""
    groups = _pick(rng, ([16], [4, 4, 4, 4], [4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3], [13], [15], [6, 7]))
    body = str(rng.integers(3, 7)) + _digits(rng, sum(groups) - 2)
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(body))))
    digits = body + str(-total % 10)
    seps = (" ", "-", ".", "/", " - ", "_", "  ")
    one, mixed = _pick(rng, seps), rng.random() < 0.25
    out = digits[: groups[0]]
    for k in range(1, len(groups)):
        out += (_pick(rng, seps[:4]) if mixed else one) + digits[sum(groups[:k]) : sum(groups[: k + 1])]
    return out


def _phone(rng, named: bool) -> str:
    """named: beside a word that says so. Without one, forms that speak for themselves."""
    d = lambda n: _digits(rng, n)
    a, b, c = str(rng.integers(2, 10)) + d(2), d(3), d(4)
    plain = (
        f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)}-{d(2)}-{b}-{c}", f"00{d(2)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}",
        f"0{d(2)}/{d(7)}", f"0{d(3)}/{d(7)}", f"0{d(3)}/{d(6)}", f"+{d(2)} (0) {d(2)} {c} {c}", f"{a}/{b}-{c}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(2)} {d(7)}", f"0{d(3)} {d(6)}", f"0{d(3)} {d(7)}", f"0{d(4)} {d(6)}", f"0{d(2)}-{d(4)}-{d(4)}",
        f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"(0{d(2)}) {d(4)} {d(4)}", f"(0{d(3)}) {d(6)}", f"0{d(3)}-{d(7)}", f"0{d(3)} - {d(7)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}")
    if rng.random() < 0.3:  # national prefixes, whose forms are many
        parts = _pick(rng, ((3, 7), (4, 7), (3, 8), (4, 6), (5, 6), (3, 4, 4), (4, 3, 4), (4, 7), (2, 2, 2, 2, 2), (3, 3, 2, 2), (5, 3, 3)))
        body = _pick(rng, (" ", " ", " ", "-", "/", ".", " - ")).join(d(n) for n in parts)
        return ("00" if rng.random() < 0.1 else "0") + body[1:]
    return _pick(rng, (*plain, f"{a} {b} {c}", f"{a}{b}{c}", f"0{d(10)}", f"{a} {b}{c}") if named else plain)


def _entity(rng, kind: str) -> str:
    d = lambda n: _digits(rng, n)
    if kind == "email":
        at = _pick(rng, AT)
        dot = _pick(rng, DOT.get(at, (".",)))
        name = lambda: _pick(rng, (_word(rng).lower(), _word(rng).lower(), _pick(rng, NAMES)))
        user = name() + _pick(rng, ("", ".", ".", "_", "-", "+")) + _pick(rng, (name(), name(), d(2), d(1), "x", ""))
        user = user.rstrip("._-+")
        if at not in ("@", " @ ", "@ ") and "." in user and rng.random() < 0.5:
            user = user.replace(".", dot)
        host = _pick(rng, ("mail", "post", "web", "example", "example", name())) + _pick(rng, ("", "", d(1))) + _pick(rng, (".example", "-" + _word(rng).lower(), "", "", ""))
        out = user + at + (host + _pick(rng, (".com", ".com", ".org", ".net", ".de", ".co.uk", ".ac.uk", ".info"))).replace(".", dot)
        return out.upper() if rng.random() < 0.06 else out
    if kind == "ip":
        top = _pick(rng, (10, 100, 256, 256))
        return _pick(rng, (".", ".", " . ", "[.]", "[.]", "(.)")).join(str(rng.integers(0 if k else 1, top)) for k in range(4))
    if kind == "card":
        return _card(rng)
    raise ValueError(kind)


def _decoy(rng) -> str:
    d = lambda n: _digits(rng, n)
    w = lambda: _word(rng)
    numbers = (f"20{d(2)}-0{d(1)}-1{d(1)}", f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}", f"${d(1)},{d(3)}.{d(2)}", f"{d(3)}", f"#{d(5)}", f"{d(8)}", f"{d(1)}.{d(3)}", f"{d(4)}", f"{d(1)}{d(3)}%", f"{d(2)}/{d(2)}/20{d(2)}", f"({d(1)})", f"{d(1)},{d(3)},{d(3)}", f"{d(2)}.{d(2)}", f"pp. {d(2)}-{d(3)}", f"{d(3)}x{d(3)}", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(30)}", f"Version {d(1)}.0.", f"{d(4)} {d(4)}", f"{d(1)} {d(2)} {d(1)} {d(2)}", f"20{d(2)}-20{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"1.{d(1)}.{d(1)}", f"{d(5)}-{d(4)}", f"[{d(2)}]")
    n = str(rng.integers(1, 10))
    counts = [_pick(rng, AMOUNTS) + x for x in (
        f"{n} {d(3)} {d(3)} {d(3)}", f"{n}{d(1)} {d(3)} {d(3)}", f"{n}{d(2)} {d(3)} {d(3)}", f"{n}{d(2)} {d(3)} {d(4)} {d(1)}", f"{n},{d(3)},{d(3)},{d(3)}", f"{n}{d(9)}", f"{n}{d(10)}", f"{n}{d(3)} {d(4)} {d(4)} {d(4)} {d(2)}", f"{n}{d(3)}-{d(4)}", f"{n}.{d(3)}.{d(3)}.{d(3)}", f"{n}{d(1)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{n}{d(1)}, {d(2)}, {d(2)}, {d(3)}", f"{n}{d(4)} {d(5)} {d(4)}")]
    if rng.random() < 0.4:
        return _pick(rng, counts)
    mixed = (f"{w()} at a dot {w()}", f"at the dot {w()}", f"{w()} dot com", f"look at {w()} dot {w()} dot", f"(at) {w()}", f"[dot] {w()}", "".join(_pick(rng, "0123456789abcdef") for _ in range(40)), f"@{w().lower()}", f"at {w()}", f"dot {w()}", f"{w()} at {w()} dot", f"(at {w()})", f"{w()}{d(3)}", f"http://{w().lower()}.com/{d(6)}")
    return _pick(rng, numbers if rng.random() < 0.7 else mixed)


def labelled_texts(count: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up sentences with their spans (kind, start, end)."""
    rng = np.random.default_rng(seed)
    gaps = (*[" "] * 12, ", ", ". ", ".\n", "\n", ": ", "; ", "### ", ") ", "!! ")
    out = []
    for k in range(count):
        text, spans = "", []
        size = WINDOW + 40 if k % 3 else int(rng.integers(5, WINDOW))  # a third are short texts
        while len(text) < size:
            r = rng.random()
            if r < 0.11:
                kind = _pick(rng, KINDS)
                named = kind == "phone" and rng.random() < 0.5
                text += _pick(rng, CALLED) if named else ""
                e = _phone(rng, named) if kind == "phone" else _entity(rng, kind)
                spans.append((kind, len(text), len(text) + len(e)))
                text += e
            elif r < 0.19:
                text += _decoy(rng)
            else:
                text += _word(rng)
            text += _pick(rng, gaps)
        out.append((text, spans))
    return out


def tagged(text: str, spans: list[tuple[str, int, int]], at: int, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """One window of a text: symbols and tags; a span cut by its left edge is left out."""
    ids, tags = np.zeros(size, np.int64), np.zeros(size, np.int64)
    s = symbols(text[at : at + size])
    ids[: len(s)] = s
    for kind, a, b in spans:
        a, b = a - at, min(b - at, size)
        if 0 <= a < b:
            tags[a] = 1 + 2 * KINDS.index(kind)
            tags[a + 1 : b] = 2 + 2 * KINDS.index(kind)
    return ids, tags


def trained(examples: int = EXAMPLES, steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    rows = [tagged(t, s, int(rng.integers(0, max(1, min(40, len(t) - WINDOW + 1))))) for t, s in labelled_texts(examples, seed)]
    return fit(np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows]), steps, seed=seed)


def settings() -> str:
    return f"examples {EXAMPLES} steps {STEPS} seed {SEED} embed {EMBED} hidden {HIDDEN} window {WINDOW} symbols {SYMBOLS} kinds {' '.join(KINDS)}"


@lru_cache(maxsize=1)
def default_model() -> dict[str, np.ndarray]:
    """The parameters kept beside this file, if they were trained under these settings; else trained now."""
    try:
        raw = pkgutil.get_data("cuelight.llm", FILE)
    except FileNotFoundError:
        return trained()
    kept = dict(np.load(io.BytesIO(raw)))
    return kept if str(kept.pop("settings")) == settings() else trained()


if __name__ == "__main__":
    np.savez_compressed(Path(__file__).parent / FILE, settings=settings(), **trained())
