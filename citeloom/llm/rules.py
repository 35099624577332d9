"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule is a predicate over a text's statistics, which are computed when first asked for and kept for the rules after.
``plan_cascade`` runs every rule on a sample of documents, measures its time and its rejections, and orders
the rules by rejections per second; ``apply_cascade`` then stops at each document's first failure. The verdict does not depend on the order,
only the work does; so the name of the first failing rule may differ between runs, the verdict not.

Defined results: null text counts as empty. An empty text has no words and passes rules that are shares of nothing; it fails
a minimum of words. Repeated rows are judged alike, null ids stay null, an empty table gives no rows. Other columns are passed on or ignored as each function says.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A word without ASCII letters and without letters beyond ASCII.
BARE = re.compile(rb"(?<![^ \t-\r])[^A-Za-z\x80-\xff \t-\r]+(?![^ \t-\r])")


class Statistics:
    """What the rules ask of one text, each computed at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_bare(self) -> int:
        return len(BARE.findall(self.raw))

    @cached_property
    def case(self) -> tuple[int, int]:
        """ASCII capitals and small letters."""
        size = len(self.raw)
        return size - len(self.raw.translate(None, UPPER)), size - len(self.raw.translate(None, LOWER))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that the text holds twice or more."""
        n = len(self.words)
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        at = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        size = len(number)
        if size < 2_000_000:
            key = (at[:-2] * size + at[1:-1]) * size + at[2:]
        else:
            pair = np.unique(at[:-2] * size + at[1:-1], return_inverse=True)[1]
            key = pair * size + at[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        found = np.zeros(n - 2, bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= found
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """``passes`` is true for texts the rule keeps."""

    name: str
    passes: Callable[[Statistics], bool]


#: Production rules, in whole numbers so that every engine decides alike at the border.
RULES = (
    Rule("few_words", lambda s: s.n_words >= 50),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words <= 50 * s.n_words),
    Rule("word_length", lambda s: 2 * s.n_words <= s.word_chars <= 15 * s.n_words),
    Rule("symbols", lambda s: 10 * s.n_symbols <= s.n_words),
    Rule("repeated_lines", lambda s: 2 * s.n_dup_lines <= len(s.lines)),
    Rule("bare_words", lambda s: 5 * s.n_bare <= s.n_words),
    Rule("capitals", lambda s: 10 * s.case[0] <= 6 * (s.case[0] + s.case[1])),
)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", sample_rows: int = 400, given: tuple[str, ...] = (), seed: int = 7) -> list[Rule]:
    """The rules, most rejections per second first, as measured on about ``sample_rows`` documents.

    ``given`` names statistics that are computed in any case: a rule's cost is what it adds to these. Each task measures its own part of the
    sample, of which only sums travel.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, rejected = [1e-9] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                shared = Statistics(text)
                for name in given:
                    getattr(shared, name)
                for i, rule in enumerate(rules):
                    held = Statistics(text)
                    held.__dict__.update(shared.__dict__)
                    began = time.perf_counter()
                    passed = rule.passes(held)
                    cost[i] += time.perf_counter() - began
                    rejected[i] += not passed
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(cost), pa.array(rejected, pa.int64())], ["rule", "cost", "rejected"])

    fraction = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(fraction=fraction, seed=seed)
    found = sample.mapInArrow(measure, "rule int, cost double, rejected bigint").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"))
    rate = {r["rule"]: (r["rejected"] / r["cost"], -r["cost"]) for r in found.collect()}  # a row per rule
    order = sorted(range(len(rules)), key=lambda i: rate.get(i, (0.0, 0.0)), reverse=True)
    return [rules[i] for i in order]


def first_failure(held: Statistics, cascade: list[Rule]) -> str | None:
    return next((r.name for r in cascade if not r.passes(held)), None)


def apply_cascade(docs: DataFrame, cascade: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept and failed_rule (the first in the cascade's order) of every document."""
    cascade = cascade or plan_cascade(docs, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = [first_failure(Statistics(t.as_py()), cascade) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f is None for f in failed]), pa.array(failed, pa.string())], ["doc_id", "kept", "failed_rule"])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id bigint, kept boolean, failed_rule string")


def judge_with_statistics(docs: DataFrame, cascade: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """The base statistics of every document, whether they alone reject it, and else the cascade's verdict.

    The base statistics are asked for, so they are always computed; the cascade shares them and stops at a first failure.
    """
    names = BASE
    cascade = cascade or plan_cascade(docs, text_col=text_col, given=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: list[list[int]] = [[] for _ in names]
            failed, kept = [], []
            for text in batch.column(1):
                held = Statistics(text.as_py())
                for column, name in zip(numbers, names):
                    column.append(getattr(held, name))
                failed.append(held.n_words < min_words or 100 * held.n_repeat_words > most_repeats * held.n_words)
                kept.append(not failed[-1] and first_failure(held, cascade) is None)
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in numbers], pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept"])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    fields = ", ".join(f"{n} bigint" for n in names)
    return docs.select(*columns).mapInArrow(run, f"doc_id bigint, {fields}, base_failed boolean, kept boolean")


RULES_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), positions AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)
), found AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM positions) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + s) AS n FROM found CROSS JOIN (VALUES (0), (1), (2)) AS t(s) GROUP BY doc_id
), base AS (
  SELECT split.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_bare,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM split LEFT JOIN covered ON split.doc_id = covered.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars BETWEEN 2 * n_words AND 15 * n_words
         AND 10 * n_symbols <= n_words
         AND 2 * n_dup_lines <= n_lines
         AND 5 * n_bare <= n_words
         AND 10 * n_upper <= 6 * (n_upper + n_lower) AS kept
FROM base
"""
