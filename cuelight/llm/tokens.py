"""Encoding with a public tokenizer, chunk by chunk.

Byte-level and word-end BPE never merge across the chunks that their splitting
pattern makes, so a chunk's ids are the same in any text. Most chunks of a corpus
come again and again: each is encoded once by the tokenizers library and kept in
a bounded cache as little-endian bytes, and a text is a join of such bytes.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cuelight.llm.common import give_back, own_worker

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

LETTERS, MARKS = r"[^\W\d_]+", r"(?:[^\w\s]|_)+"
SUFFIX = r"'(?:s|t|re|ve|m|ll|d)"
#: What the byte-level pattern parts: a space goes with what follows it.
BYTE_CHUNK = re.compile(rf"{SUFFIX}| ?{LETTERS}| ?\d+| ?{MARKS}|\s+(?!\S)|\s+")
#: What the word-end pattern parts, once white space is dropped.
WORD_CHUNK = re.compile(rf"{SUFFIX}|{LETTERS}|\d|{MARKS}")
#: Letters that the library's first steps leave as they are: one chunk, in normal form, small where case goes.
BYTE_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
WORD_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: White space to some libraries only, and the capital whose small form has two characters.
APART = "\x1c\x1d\x1e\x1fİ"

#: Entries in the newer of two generations of a cache.
CACHED = 400_000
RUN = 4096


def odd_characters() -> re.Pattern:
    """Chunks with these make their text be encoded whole: white space and
    controls that libraries class apart, letter-like numbers, letters whose
    small form hangs on their place, what normal forms compose, special tokens."""
    odd = [c for c in range(0x11000) if unicodedata.category(chr(c)) in ("No", "Nl", "Cn", "Mn", "Mc", "Me", "Cf") or 0x1100 <= c <= 0x11FF or 0xD800 <= c <= 0xDFFF]
    odd += [*range(9), *range(14, 32), *range(0x7F, 0xA1), 0x130, 0x3A3, 0x3C2, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    runs, last = [], None
    for c in sorted(set(odd)):
        if last is not None and c == last + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
        last = c
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + r"\U00011000-\U0010ffff]|<\|")


def default_path(name: str) -> str:
    """Where the installed vocabularies have the file of this name."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache:
    """Two generations: what is not met again while the newer one fills goes."""

    def __init__(self, learn):
        self.new: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.learn = learn

    def ready(self, keys: set[str]):
        """A getter that has all the keys."""
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = keys.difference(new)
        again = missing.intersection(old)
        new.update(zip(again, map(old.__getitem__, again)))
        missing = list(missing - again)
        if missing:
            new.update(zip(missing, self.learn(missing)))
        return new.__getitem__


class Encoder:
    """ids of texts as bytes of little-endian unsigned 32-bit integers.

    A text is cut at its blanks and the pieces are looked up; an unknown piece is
    cut as the tokenizer's own pattern cuts, and those chunks are looked up; the
    library encodes unknown chunks, many in one call. Where blanks come in runs
    the pattern cuts the whole text, and a text with odd characters goes to the
    library whole. Tests compare the ids with the library's.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.spaced = self._ids(" a") != self._ids("a")  # byte-level: a space counts
        self.plain = Tokenizer.from_file(path)  # the same model behind a plain cut at line ends
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self.plain.encode("\n", add_special_tokens=False).ids
        self.chunk = BYTE_CHUNK if self.spaced else WORD_CHUNK
        self.is_plain = (BYTE_PLAIN if self.spaced else WORD_PLAIN).fullmatch
        self.odd = odd_characters()
        self.chunks = Cache(self._encode_chunks)
        self.pieces = Cache(self._encode_pieces)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _encode_chunks(self, chunks: list[str]) -> list[bytes | None]:
        out: dict[str, bytes | None] = {}
        plain, other = [], []
        for c in chunks:
            if self.is_plain(c):
                plain.append(c)
            elif self.odd.search(c):
                out[c] = None
            else:
                other.append(c)
        if len(self.mark) != 1:
            plain, other = [], plain + other
        out.update(zip(other, (np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(other, add_special_tokens=False))))
        for k in range(0, len(plain), RUN):
            part = plain[k : k + RUN]
            ids = np.array(self.plain.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark[0]) * 4
            raw = ids.tobytes()
            out.update(zip(part, [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)])]))
        return [out[c] for c in chunks]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes | None]:
        """None for a piece whose ids hang on its neighbours: one that is empty,
        begins or ends with white space, or has an odd character. A line end
        takes the place of the space before its piece, and is a chunk itself."""
        out: dict[str, bytes | None] = {}
        lead = " " if self.spaced else ""
        letters = {p: lead + p for p in pieces if p.isalpha()}  # one chunk
        out.update(zip(letters, map(self.chunks.ready(set(letters.values())), letters.values())))
        rest = [p for p in pieces if p not in letters]
        cut: list[list[str] | None] = []
        for p in rest:
            if p == "\n" and self.spaced:
                cut.append([p])
            elif not p or p[-1].isspace():
                cut.append(None)
            elif p[0] == "\n" and self.spaced and not p[1].isspace():
                cut.append(["\n", *self.chunk.findall(p[1:])])
            elif p[0].isspace():
                cut.append(None)
            else:
                cut.append(self.chunk.findall(lead + p))
        out.update(zip(rest, self._join(cut)))
        return [out[p] for p in pieces]

    def _join(self, cut: list[list[str] | None]) -> list[bytes | None]:
        get = self.chunks.ready(set().union(*[c for c in cut if c]))
        out = []
        for c in cut:
            try:
                out.append(None if c is None else b"".join(map(get, c)))
            except TypeError:  # an odd chunk
                out.append(None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Nothing here is cyclic, and the collector would
        walk the caches again and again, so it rests meanwhile."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def rest(self) -> None:
        """At a task's end: the older generations go, the newer ones stay for the next task."""
        self.chunks.old, self.pieces.old = {}, {}
        give_back()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Arrow cuts the texts, numbers the distinct pieces, and strings their
        bytes together; Python sees each distinct piece of the batch once."""
        if not texts:
            return []
        rows = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).cast(pa.string(), safe=False)
        if self.spaced:
            lists = pc.split_pattern(pc.replace_substring(rows, "\n", " \n"), " ")
        else:
            lists = pc.ascii_split_whitespace(pc.ascii_trim(pc.utf8_lower(rows), " \t\n\x0b\x0c\r"))
        ends = lists.offsets.to_numpy()
        flat = lists.values[ends[0] : ends[-1]].dictionary_encode()
        ends = ends - ends[0]
        at = flat.indices.to_numpy().copy()
        distinct = flat.dictionary.to_pylist()
        values = list(map(self.pieces.ready(set(distinct)), distinct))
        if self.spaced:  # a text's first piece has no space before it
            heads = [t.split("\n", 1)[0].split(" ", 1)[0] for t in texts]
            at[ends[:-1]] = np.arange(len(values), len(values) + len(texts))
            values += self._join([self.chunk.findall(h) if not h[-1:].isspace() else None for h in heads])
            bad = [t[-1:].isspace() or "\n\n\n" in t or "\n\n " in t for t in texts]  # such runs are cut otherwise
        else:
            at[np.isin(at, [i for i, p in enumerate(distinct) if p == ""])] = len(values)  # of blank texts
            values.append(b"")
            bad = [any(c in t for c in APART) for t in texts]
        odd = np.array([v is None for v in values])
        ids = pa.array([v or b"" for v in values], pa.large_binary()).take(pa.array(at))
        starts = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1][ends]
        bad = np.array(bad) | (np.diff(np.concatenate([[0], np.cumsum(odd[at])])[ends]) > 0)
        raw = ids.buffers()[2]
        out: list[bytes | None] = [None if b else raw[x:y].to_pybytes() if y > x else b"" for b, x, y in zip(bad.tolist(), starts[:-1].tolist(), starts[1:].tolist())]
        left = [i for i, o in enumerate(out) if o is None]
        if left and self.spaced:
            for i, found in zip(left, self._join([self.chunk.findall(texts[i]) for i in left])):
                out[i] = found
        return [self._bytes(t) if o is None else o for t, o in zip(texts, out)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    own_worker(f"tokens {path}", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts, size: int = 1024, most: int = 1 << 22):
    """Runs of texts of bounded count and length, so that no batch is large."""
    run, chars = [], 0
    for t in texts:
        t = t or ""
        run.append(t)
        chars += len(t)
        if len(run) >= size or chars >= most:
            yield run
            run, chars = [], 0
    if run:
        yield run
