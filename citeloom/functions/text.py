"""Column functions over Arabic and English text: normalisation, quality, language, identifiers, ids."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character sets of the normalisation and of the script tests.
FORMATTING = r"[\x{0640}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]+"
DIACRITICS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
FOLD_FROM = "آأإٱىیک"
FOLD_TO = "ااااييك"
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
ANSWER_LATIN = r"A-Za-z\x{00C0}-\x{024F}"
ARABIC_DIGITS = r"\x{0660}-\x{0669}\x{06F0}-\x{06F9}"
WHITE = r"[\t-\r\x1c-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_WHITE = r"[\t\x1f\x20\xA0\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
IDENTIFIER = r"(?iU)(?:المادة|قانون|قرار|مرسوم|article|law|decree|decision)\s*(?:رقم|no\.?|number)?\s*[\[(]?[\s:.-]*([0-9٠-٩]+)"
MODEL_CITATION = r"(?iU)\[\d+\]|\bE\d+\b"
# End of fixed values.

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


@F.arrow_udf(T.StringType())
def _compatibility(texts: pa.Array) -> pa.Array:
    # a few texts at a time: a batch is never there as Python strings
    some = (texts.slice(k, 64).to_pylist() for k in range(0, len(texts), 64))
    made = [pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in part], pa.string()) for part in some]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def reverse_digit_runs(text: Column) -> Column:
    """Arabic digit runs (both blocks, mixed) read backwards."""
    runs = F.regexp_extract_all(text, F.lit(f"([{ARABIC_DIGITS}]+|[^{ARABIC_DIGITS}]+)"), F.lit(1))
    turned = F.transform(runs, lambda r: F.when(r.rlike(f"^[{ARABIC_DIGITS}]"), F.reverse(r)).otherwise(r))
    return F.array_join(turned, "")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def collapse_lines(text: Column) -> Column:
    """White space collapsed and trimmed line by line; empty lines dropped."""
    spaced = F.regexp_replace(text, f"{LINE_WHITE}+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, rf" ?(?:(?:{LINE_END}) ?)+", "\n"), r"\A[ \n]+|[ \n]+\z", "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f refers to it: as a lambda's variable it is not written out anew in each place."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalize_text(text: Column, reverse_runs: bool | Column = False, compose: bool = True) -> Column:
    """The search form. ``compose`` runs NFKC, the one step without a built-in. ASCII passes all steps but the last untouched and is not sent to Python."""

    def steps(text: Column, composed: Column) -> Column:
        out = F.regexp_replace(composed, f"{FORMATTING}+", "")
        out = F.regexp_replace(out, PRIVATE_USE, " ")
        out = F.regexp_replace(out, f"{DIACRITICS}+", "")
        out = F.translate(out, FOLD_FROM, FOLD_TO)
        if isinstance(reverse_runs, Column):
            out = once(out, lambda t: F.when(reverse_runs, reverse_digit_runs(t)).otherwise(t))
        elif reverse_runs:
            out = reverse_digit_runs(out)
        return collapse_lines(F.when(is_ascii(text), text).otherwise(out))

    if not compose:
        return once(text, lambda t: steps(t, t))
    beyond = once(text, lambda t: F.when(~is_ascii(t), t))
    both = F.struct(text.alias("text"), _compatibility(beyond).alias("composed"))
    return once(both, lambda p: steps(p["text"], F.coalesce(p["composed"], p["text"])))


@lru_cache(1)
def _plain_patterns() -> list[re.Pattern]:
    """The patterns above as Python spells them; re has no code points beyond four digits in this form."""
    spelled = lambda p: re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08X}", p)
    return [re.compile(spelled(p)) for p in (FORMATTING, PRIVATE_USE, DIACRITICS, f"[{ARABIC_DIGITS}]+", LINE_END, f"[{ARABIC}]", r"\x{FFFD}")] + [re.compile(r"[\s\x1c-\x1f]+")]


_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def normalized(text: str, reverse_runs: bool = False, compose: bool = True) -> str:
    """normalize_text of one string, for code that runs inside tasks."""
    formatting, private, marks, digits, ends, *_, white = _plain_patterns()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text) if compose else text
        text = marks.sub("", private.sub(" ", formatting.sub("", text))).translate(_FOLD)
        if reverse_runs:
            text = digits.sub(lambda m: m[0][::-1], text)
    lines = (white.sub(" ", x).strip(" ") for x in ends.split(text))
    return "\n".join(x for x in lines if x)


def quality_of(text: str) -> dict[str, float]:
    """text_quality of one string."""
    *_, arabic, replaced, white = _plain_patterns()
    seen = white.sub("", text)
    n = max(1, len(seen))
    latin = sum(c.isalpha() and (c.isascii() or "LATIN" in unicodedata.name(c, "")) for c in seen)
    return {
        "character_count": len(seen), "arabic_ratio": len(arabic.findall(seen)) / n, "latin_ratio": latin / n, "replacement_ratio": len(replaced.findall(seen)) / n,
        "control_ratio": sum(unicodedata.category(c) == "Cc" for c in seen) / n,
    }


def language_of(quality: dict[str, float], minimum: int = 3, mixed_share: float = 0.20) -> str:
    """detect_language of one quality."""
    script = quality["arabic_ratio"] + quality["latin_ratio"]
    if not script or round(quality["character_count"] * script) < minimum:
        return "unknown"
    share = quality["arabic_ratio"] / script
    return "ar" if share >= 1 - mixed_share else "en" if share <= mixed_share else "mixed"


def needs_ocr(quality: dict[str, float], expected: str = "ar", minimum_characters: int = 50, minimum_script: float = 0.20) -> bool:
    """requires_ocr of one quality."""
    script = {"ar": quality["arabic_ratio"], "en": quality["latin_ratio"]}.get(expected, quality["arabic_ratio"] + quality["latin_ratio"])
    return quality["character_count"] < minimum_characters or quality["replacement_ratio"] > 0.01 or quality["control_ratio"] > 0.01 or script < minimum_script


@lru_cache(1)
def latin_class() -> str:
    """Ranges of letters whose Unicode name holds LATIN."""
    points = [c for c in range(0x20000) if chr(c).isalpha() and "LATIN" in unicodedata.name(chr(c), "")]
    ranges: list[list[int]] = []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def text_quality(text: Column) -> Column:
    """struct of the number of visible characters and four shares of them."""
    seen = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", "")
    # ASCII is told by one small class; only what lies beyond it meets the large ones
    beyond = F.regexp_replace(seen, r"[\x00-\x7F]+", "")
    n = F.greatest(F.length(seen), F.lit(1))
    kept = lambda of, keep: F.length(F.regexp_replace(of, f"[^{keep}]+", ""))
    return F.struct(
        F.length(seen).alias("character_count"),
        (kept(beyond, ARABIC) / n).alias("arabic_ratio"),
        ((kept(seen, "A-Za-z") + kept(beyond, latin_class())) / n).alias("latin_ratio"),
        (kept(beyond, r"\x{FFFD}") / n).alias("replacement_ratio"),
        (kept(seen, r"\x00-\x1F\x7F-\x9F") / n).alias("control_ratio"),
    )


def detect_language(quality: Column, minimum: int = 3, mixed_share: float = 0.20) -> Column:
    """ar, en, mixed or unknown by the share of Arabic among script characters."""
    script = quality["arabic_ratio"] + quality["latin_ratio"]
    share = F.try_divide(quality["arabic_ratio"], script)
    return (
        F.when((F.bround(quality["character_count"] * script) < minimum) | (script == 0), "unknown")
        .when(share >= 1 - mixed_share, "ar")
        .when(share <= mixed_share, "en")
        .otherwise("mixed")
    )


def resolve_language(quality: Column, expected: str = "auto") -> Column:
    return detect_language(quality) if expected == "auto" else F.lit(expected)


def requires_ocr(quality: Column, expected: str = "ar", minimum_characters: int = 50, minimum_script: float = 0.20) -> Column:
    script = {"ar": quality["arabic_ratio"], "en": quality["latin_ratio"]}.get(expected, quality["arabic_ratio"] + quality["latin_ratio"])
    return (quality["character_count"] < minimum_characters) | (quality["replacement_ratio"] > 0.01) | (quality["control_ratio"] > 0.01) | (script < minimum_script)


def identifiers(text: Column) -> Column:
    """Distinct numbers of laws, articles, decrees and decisions, in ASCII digits."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1))
    return F.array_distinct(F.transform(found, ascii_digits))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def answer_matches_language(answer: Column, language: Column, minimum: float = 0.6) -> Column:
    letters = F.regexp_replace(answer, r"(?U)[^\p{IsAlphabetic}]+", "")
    n = F.length(letters)
    share = lambda keep: F.length(F.regexp_replace(letters, f"[^{keep}]+", "")) / F.greatest(n, F.lit(1))
    return F.when(language == "mixed", True).when(n == 0, False).when(language == "ar", share(ARABIC) >= minimum).when(language == "en", share(ANSWER_LATIN) >= minimum).otherwise(False)


def holds_model_citation(answer: Column) -> Column:
    return answer.rlike(MODEL_CITATION)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """RFC 4122 version 5 from built-in SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def chunk_id(*parts: Column) -> Column:
    """SHA-256 over colon-joined parts; nulls count as empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
