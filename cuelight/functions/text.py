"""Text and number functions on columns, free of Python at run time.

Unicode classes (\\p{L}, \\p{N}) stand for letters and digits, as Java's \\w and
\\d know ASCII only. White space is [\\s\\p{Z}].
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]+"

# Vietnamese letters that mark syllabic text, digit words, languages, marks.
SYLLABIC = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
DIGIT_WORDS = {"0": "không", "1": "một", "2": "hai", "3": "ba", "4": "bốn", "5": "năm", "6": "sáu", "7": "bảy", "8": "tám", "9": "chín"}
LANGUAGES = {
    "arabic": "ar", "burmese": "my", "cantonese": "yue", "chinese": "zh", "dutch": "nl", "english": "en", "filipino": "tl", "french": "fr", "german": "de",
    "hindi": "hi", "indonesian": "id", "italian": "it", "japanese": "ja", "khmer": "km", "korean": "ko", "lao": "lo", "malay": "ms", "mandarin": "zh",
    "polish": "pl", "portuguese": "pt", "russian": "ru", "spanish": "es", "tagalog": "tl", "thai": "th", "turkish": "tr", "ukrainian": "uk", "vietnamese": "vi",
}
DETECT = ("auto", "auto-detect", "detect")
NO_SPACE = ("ja", "km", "lo", "my", "th", "yue", "zh")
SENTENCE_END = ".?!…。！？"
TRANSIENT_CODES = (429, 500, 502, 503, 504)
TRANSIENT_MARKS = ("429", "500 internal", "502", "503", "504", "high demand", "internal server error", "overloaded", "rate limit", "resource_exhausted", "timed out", "timeout", "unavailable")
#: The marks as a pattern, read alike by Java and Python; they hold no special characters.
TRANSIENT_PATTERN = "|".join(TRANSIENT_MARKS)
MODEL_SETTINGS = ("apply_watermark", "crossfade_p", "max_chars", "max_new_frames", "repetition_penalty", "repetition_window", "silence_p", "temperature", "top_k", "top_p", "use_ref_codes")


#: The characters of SPACE.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(s, F.lit(BLANKS))


def tokens(s: Column) -> Column:
    return F.filter(F.split(F.coalesce(s, F.lit("")), SPACE), lambda t: t != "")


def syllables(s: Column) -> Column:
    """White-space tokens with a letter or digit."""
    return F.size(F.filter(tokens(s), lambda t: t.rlike(r"[\p{L}\p{N}]")))


def let(value: Column, body) -> Column:
    """body(value), with value computed once wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_digit(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike(r"\p{Nd}")


def syllabic(s: Column) -> Column:
    return F.translate(F.coalesce(s, F.lit("")), SYLLABIC + SYLLABIC.upper(), "") != F.coalesce(s, F.lit(""))


def natural_seconds(s: Column, rate: float = 6.0) -> Column:
    """How long a line takes to say: by syllables where the script is syllabic, else by length."""
    return F.when(syllabic(s), F.greatest(F.lit(0.6), 0.25 + syllables(s) / rate)).otherwise(F.greatest(F.lit(0.8), 0.35 + F.length(F.coalesce(s, F.lit(""))) / 15.5))


def retry_seconds(s: Column, attempt: Column, overshoot: float = 1.12) -> Column:
    """The duration asked for from the second attempt on; null before."""
    return F.when(attempt >= 2, natural_seconds(s) * (1 + 0.1 * (attempt - 1)) / overshoot)


def script_words(s: Column) -> Column:
    """Lower-case words without marks; numbers of one or two digits are spelled
    digit by digit, as speech recognisers write spoken numbers as digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}_\s\p{Z}]", " ")
    spelled = F.create_map(*[F.lit(x) for kv in DIGIT_WORDS.items() for x in kv])
    spell = lambda w: F.when(w.rlike("^[0-9]{1,2}$"), F.transform(F.split(w, ""), lambda d: spelled[d])).otherwise(F.array(w))
    return F.flatten(F.transform(tokens(plain), spell))


def accent_table(top: int = 0x1F00) -> tuple[str, str]:
    """Composed letters below `top` and their bases, from Unicode's decompositions; đ has none."""
    pairs = [("đ", "d"), ("Đ", "D")]
    for c in map(chr, range(0xC0, top)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_tones(s: Column) -> Column:
    """Diacritics folded away; case stays."""
    return F.regexp_replace(F.translate(s, *accent_table()), r"\p{Mn}", "")


def fold(s: Column) -> Column:
    return strip(F.lower(strip_tones(s)))


def strip_markup(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"<[^>]+>|\{[^}]+\}", "")


def is_shouted(s: Column) -> Column:
    """Every letter is upper case, and there is one."""
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\p{L}]", "").rlike(r"^\p{Lu}+$")


def is_caption(s: Column) -> Column:
    """The whole text stands in brackets of any kind."""
    return F.coalesce(s, F.lit("")).rlike(r"(?s)^[\s\p{Z}]*[\(\[\{].*[\)\]\}][\s\p{Z}]*$")


def join_words(ws: Column, language: Column) -> Column:
    parts = F.transform(ws, strip)
    return strip(F.when(language.isin(*NO_SPACE), F.array_join(parts, "")).otherwise(F.array_join(parts, " ")))


def non_blank(s: Column) -> Column:
    return F.when(strip(s) != "", s)


def language_code(name: Column) -> Column:
    """ISO code of a language name or code; null asks for detection; an unknown name is an error."""
    low = F.lower(strip(F.coalesce(name, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    refused = F.raise_error(F.concat(F.lit("Unknown language: "), name))
    return F.when((low == "") | low.isin(*DETECT), F.lit(None).cast("string")).when(F.map_contains_key(known, low), known[low]).when(low.rlike("^[a-z]{2,3}$"), low).otherwise(refused)


def is_transient(code: Column, message: Column) -> Column:
    """An API failure worth another try: by status, or by what the message says."""
    return F.coalesce(code.isin(*TRANSIENT_CODES), F.lit(False)) | F.coalesce(message, F.lit("")).rlike(f"(?i){TRANSIENT_PATTERN}")


def model_settings(settings: Column) -> Column:
    """Those entries of a settings map that the model knows and that have a value; false and 0 are values."""
    return F.map_filter(settings, lambda k, v: k.isin(*MODEL_SETTINGS) & v.isNotNull())


def clip_error(message: Column, most: int = 500) -> Column:
    return F.substring(message, 1, most)


def cause_chain(causes: Column, most: int = 4) -> Column:
    """An error and what caused it, as providers.why() puts them. Fixed value: what joins them."""
    return F.array_join(F.slice(causes, 1, most), " <- caused by ")


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of integer milliseconds."""
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.when(hours < 10, pad(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit(","), pad(ms % 1000, 3))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norm != 0, norm))


def rms(samples: Column) -> Column:
    n = F.size(samples)
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(n > 0, F.sqrt(power / F.when(n > 0, n))).otherwise(0.0)


def dbfs(samples: Column, floor: float = -99.0) -> Column:
    """Level in dB of full scale; `floor` for silence: -99 in the mixer, -120 in the studio."""
    r = rms(samples)
    return F.when(r > 0, F.greatest(F.lit(floor), 20 * F.log10(F.when(r > 0, r)))).otherwise(floor)


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def cue_file(idx: Column) -> Column:
    return F.format_string("cue_%05d.wav", idx.cast("int"))


def line_file(idx: Column, ext: str = "wav") -> Column:
    """Name of a line, counted from 1, in an archive."""
    return F.format_string(f"%04d.{ext}", idx.cast("int") + 1)


def job_path(owner: Column, job: Column, name: Column) -> Column:
    return F.concat_ws("/", owner.cast("string"), job.cast("string"), name)


def worker_label(label: Column, notebook: Column, pod: Column, host: Column) -> Column:
    """How a worker is shown: its own label, else the notebook service, else its
    pod's first eight characters, else its host."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(label), F.when(notebook, "Colab"), F.concat(F.lit("RunPod "), F.substring(some(pod), 1, 8)), some(host), F.lit("worker"))


def device(spec: Column, cuda: Column) -> Column:
    """struct(name, index) of 'cuda:1' and the like; cuda where none is named,
    the processor where there is no cuda; index 0 where none is given."""
    spec = F.coalesce(F.nullif(spec, F.lit("")), F.lit("cuda"))
    name, index = F.split_part(spec, F.lit(":"), F.lit(1)), F.regexp_extract(spec, "^[^:]*:([0-9]+)$", 1)
    return F.struct(F.when((name == "cuda") & ~cuda, "cpu").otherwise(name).alias("name"), F.coalesce(F.nullif(index, F.lit("")).cast("int"), F.lit(0)).alias("index"))


def compute_type(name: Column, memory_gb: Column) -> Column:
    """Half precision where the device's memory holds two models, or isn't known."""
    return F.when(name != "cuda", "int8").when(memory_gb < 10, "int8_float16").otherwise("float16")
