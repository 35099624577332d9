"""Numeric claims: extraction of numbers, millions and legal thresholds, and their validation against evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import ascii_digits

# Number forms, number words, units and threshold phrases.
NUMBER = r"(?:[0-9]+(?:[.,][0-9]+)*|[٠-٩]+(?:[٫،.][٠-٩]+)*)"
NUMBER_WORDS = {
    "صفر": 0, "واحد": 1, "واحدة": 1, "اثنان": 2, "اثنين": 2, "اثنتان": 2, "اثنتين": 2, "ثلاثة": 3, "ثلاث": 3, "أربعة": 4, "أربع": 4,
    "خمسة": 5, "خمس": 5, "ستة": 6, "ست": 6, "سبعة": 7, "سبع": 7, "ثمانية": 8, "ثمان": 8, "تسعة": 9, "تسع": 9, "عشرة": 10,
}
ARABIC_MILLION = "مليون|ملايين|مليونًا|مليوناً"
MILLION = ARABIC_MILLION + "|million|millions"
THRESHOLDS = (
    r"(?:أقل|اقل|أقل من|اقل من)\s*(?:قيمة\s*)?(?:الدعوى|الدعاوى|المنازعة|المنازعات)?\s*{n}\s*(?:مليون|ملايين|million|millions)",
    r"(?:تقل|يقل)\s*(?:قيمتها|قيمته|القيمة)?\s*(?:عن|على)?\s*{n}\s*(?:مليون|ملايين|million|millions)",
    r"(?:لا تجاوز|لا يجاوز|لا تتجاوز|لا يتجاوز)\s*(?:قيمتها|قيمته|القيمة)?\s*{n}\s*(?:مليون|ملايين|million|millions)",
    r"(?:تزيد|يزيد)\s*(?:قيمتها|قيمته|القيمة)?\s*(?:على|عن)\s*{n}\s*(?:مليون|ملايين|million|millions)",
    r"(?:تجاوز|تجاوزت|يتجاوز|تتجاوز)\s*(?:قيمتها|قيمته|القيمة)?\s*{n}\s*(?:مليون|ملايين|million|millions)",
)
# End of fixed values.


def normalize_number(value: Column) -> Column:
    """ASCII digits, the Arabic decimal mark as a point, no grouping commas, no outer points."""
    plain = F.translate(ascii_digits(value), "٫،", ".,")
    return F.regexp_replace(F.regexp_replace(plain, ",", ""), r"^\.+|\.+$", "")


def numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), normalize_number))


def _word_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in (pair[0], str(pair[1]))])


def number_words(text: Column) -> Column:
    """Values of the number words that stand alone among spaces and marks."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(_word_map(), w)), lambda v: v.isNotNull()))


def _names_millions(text: Column) -> Column:
    """Whether a text can hold a million at all: what all spellings share."""
    return F.lower(text).contains("million") | text.contains("ملي") | text.contains("ملايين")


def million_values(text: Column) -> Column:
    """``"<n> million"`` for every amount in digits or in an Arabic number word."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(rf"(?iU)({NUMBER})\s*(?:{MILLION})"), F.lit(1)), normalize_number)
    words = F.regexp_extract_all(text, F.lit(rf"(?iU)({'|'.join(NUMBER_WORDS)})\s*(?:{ARABIC_MILLION})"), F.lit(1))
    spelled = F.transform(words, lambda w: F.element_at(_word_map(), w))
    found = F.transform(F.array_union(digits, spelled), lambda n: F.concat(n, F.lit(" million")))
    return F.when(text.isNotNull(), F.when(_names_millions(text), found).otherwise(F.array().cast("array<string>")))


def million_number(value: Column) -> Column:
    return F.regexp_replace(value, " million", "").cast("double")


def threshold_values(text: Column) -> Column:
    """The million values that a threshold phrase states, in ASCII digits, in the lower-cased text.

    A phrase and the word for million enclose nothing but white space and the number, so the number is captured and compared.
    """
    low = F.lower(text)
    stated = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit("(?U)" + p.replace("{n}", "([0-9][0-9.]*)")), F.lit(1)) for p in THRESHOLDS]))
    values = million_values(text)
    return F.when(F.size(values) > 0, F.array_intersect(values, F.transform(stated, lambda n: F.concat(n, F.lit(" million"))))).otherwise(values)


def validate_numeric_claims(query: Column, answer: Column, evidence: Column) -> Column:
    """struct(ok, unsupported, evidence_values).

    Unsupported are the answer's numbers found in neither query nor evidence, its thresholds that the evidence does not state as
    thresholds, and its million values found in neither.
    """
    plain = F.array_except(F.array_except(numbers(answer), numbers(query)), numbers(evidence))
    bounds = F.array_except(threshold_values(answer), threshold_values(evidence))
    millions = F.array_except(F.array_except(million_values(answer), million_values(query)), million_values(evidence))
    bad = F.array_sort(F.array_union(F.array_union(plain, bounds), millions))
    return F.struct((F.size(bad) == 0).alias("ok"), bad.alias("unsupported"), F.array_sort(F.array_union(numbers(evidence), million_values(evidence))).alias("evidence_values"))
