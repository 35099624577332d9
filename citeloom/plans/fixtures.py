"""Literal rows for operators that the synthetic tables cannot exercise, as a DataFrame and as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = [
    (1, "المادة رقم ١٢ من القانون رقم 34 لسنة ٢٠٢٠"),
    (2, "Article 12 and Law No. 7, see also decree (9)"),
    (3, "لا تتجاوز قيمتها 5 مليون جنيه"),
    (4, "The amount is 3,500.75 or 5 million; the rest 1,000."),
    (5, "خمسة ملايين جنيه و ٣ مليون"),
    (6, "عـــربيّ نصٌّ مُشَكَّل مع إحالة على المكتبة"),
    (7, "تقل قيمتها عن 2 مليون وتزيد على 9 million"),
    (8, "No numbers at all."),
    (9, "٢٠٢٤/١٢ ثم ۱۲۳ ثم 45"),
    (10, ""),
    (11, "يتجاوز القيمة 4.5 مليون"),
    (12, "ab ١٢٣٤۵ cd"),
]
LINES = [
    (1, "الباب الأول: أحكام عامة"), (2, "الكتاب الثاني"), (3, "الجزء الثالث"), (4, "الفصل الرابع"), (5, "القسم الخامس"), (6, "المادة (12) التعريفات"), (7, "مادة 7"),
    (8, "PART II Scope"), (9, "Chapter 3"), (10, "section 4.1 Terms"), (11, "Article 5 Terms"), (12, "Articles of association"), (13, "ARTICLE (12 bis) on fees"), (14, "Part of the text"),
    (15, "(1) - first clause"), (16, "a) second clause"), (17, "٣. third clause"), (18, "plain prose line"), (19, ""), (20, "partly covered"), (21, "1.no space"), (22, "B: named"),
]
CLAIMS = [
    (1, "ما هو الحد؟", "الحد 5 million", "لا تتجاوز 5 million"),
    (2, "limit?", "It is 1,000.", "It is 1000 exactly"),
    (3, "limit?", "It is 12", "nothing here"),
    (4, "is it 12?", "It is 12", "nothing here"),
    (5, "q", "يتجاوز 3 مليون", "المبلغ 3 مليون"),
    (6, "q", "٣ مليون", "ثلاثة ملايين"),
    (7, "q", "no numbers", ""),
    (8, "q", "3.0 and 3", "3"),
]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The rows as a DuckDB FROM item."""

    def literal(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS t({names})"
