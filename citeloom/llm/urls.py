"""URL filter: listed rules first, then naive Bayes over segmented host words and path tokens.

Host names run words together. Each distinct host label and path token is cut into words by a Viterbi search for the most likely sequence
under a unigram model, whose counts come from the pages' own text and from seed words; unknown stretches pay for every letter. For the search,
the substrings are joined with the counts, so the unigram table is never broadcast.

There are no verdicts to learn from. Seed words among the segmented ones are noisy signs of pages to block, and nothing is known of the
other pages. The multinomial naive Bayes is learned by expectation maximisation: first the seeds alone give each page's probability;
then tokens are counted by these probabilities, and pages scored anew by the share of blocking pages, by the seed's sign, which is worth
SIGN to one and no more, and by all other tokens. Seed words themselves are no tokens. So the company of a seed word decides with it: words that stand with seeds block
pages without one, and a seed among tokens of allowed pages does not block. Each token's counts start from ALPHA observations at the
overall share. Pages are counted and scored by distinct (host, path words), so a host with a third of all pages is one row for each shape of path;
probabilities and odds are rounded to millionths before they are summed, so that reruns agree.

Defined results: a null url or one without "://" has an empty host and path, no rule fits it, and it is scored on the prior alone.
Null html adds no words. Repeated rows are judged alike. An empty table gives no rows. Other columns are ignored. A word is a run of letters,
whatever the alphabet, of at most LONGEST: no label of a host name may be longer, and longer stretches are cut like unknown ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.skew import with_label
from citeloom.session import Scratch

#: Rules: verdict, host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words that mark a page as an example for blocking.
BLOCK_SEEDS = ("adult", "ads", "bets", "betting", "casino", "escort", "gambling", "jackpot", "pills", "poker", "porn", "slots", "spam", "viagra", "warez", "xxx")
#: Words that often stand beside others in names; they only help the segmentation.
NAME_SEEDS = ("best", "blog", "book", "buy", "cheap", "city", "club", "daily", "farm", "free", "home", "live", "news", "online", "play", "shop", "store", "track", "travel", "web", "win", "world")
#: Letters of a word at most: the most that a label of a host name holds.
LONGEST = 63
#: What a seed word is worth in odds, the observations that each token's counts start from, and the rounds of learning.
SIGN, ALPHA, ROUNDS = 9.0, 2.0, 3
MICRO = 1_000_000
LETTERS = r"[^\p{L}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_column(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host (or a domain above it) and begins the path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, path = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _text_words(pages: DataFrame, html: str) -> DataFrame:
    """word, n: the pages' words of 1 to LONGEST letters, lower-cased."""
    letters = re.compile(r"[^\W\d_]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            some = [(w, n) for w, n in held.items() if len(w) <= LONGEST]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(letters.findall((text.as_py() or "").lower()))
                if len(held) > 300_000:
                    yield out()
        yield out()

    counted = pages.select(F.col(html).cast("string")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely words of a label; of equally likely cuts, at each place the one with fewer words, then with the longer last word.

    An unknown stretch of m letters has probability 1 / (total * 10 ** m).
    """
    unknown = [math.log(total) + m * math.log(10) for m in range(LONGEST + 1)]
    best: list[tuple[float, int]] = [(0.0, 0)]
    back = [0]
    for end in range(1, len(label) + 1):
        chosen, size = (math.inf, 0), 0
        for m in range(1, min(LONGEST, end) + 1):
            n = counts.get(label[end - m : end], 0)
            before = best[end - m]
            option = (before[0] + (math.log(total / n) if n else unknown[m]), before[1] + 1)
            if option <= chosen:
                chosen, size = option, m
        best.append(chosen)
        back.append(size)
    out, at = [], len(label)
    while at:
        out.append(label[at - back[at] : at])
        at -= back[at]
    return out[::-1]


def _substrings(labels: DataFrame) -> DataFrame:
    """no, word: the substrings of each label that a word may be, once for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[int] = []
        words: list[str] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(words, pa.string())], ["no", "word"])
            numbers.clear()
            words.clear()
            return made

        for batch in batches:
            for number, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start in range(len(label)):
                    found = [label[start:end] for end in range(start + 1, min(len(label), start + LONGEST) + 1)]
                    words += found
                    numbers += [number] * len(found)
                    if len(words) > 50_000:
                        yield out()
        yield out()

    return labels.select("no", "label").mapInArrow(run, "no bigint, word string").distinct()


def segmented(scratch: Scratch, labels: DataFrame, unigrams: DataFrame, total: int) -> DataFrame:
    """label, words for distinct labels of letters."""
    numbered = scratch.keep(labels.withColumn("no", F.monotonically_increasing_id()), "labels")
    sub = _substrings(numbered)
    held = scratch.keep(sub.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).join(unigrams, "word"), "known_words")
    rows = held.agg(F.sum("_n")).first()[0] or 0
    known = with_label(_substrings(numbered), held, "word", rows).groupBy("no").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            words = [segment(name, {k["word"]: k["n"] for k in known or []}, total) for name, known in zip(names, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    joined = scratch.again(numbered).join(known, "no", "left").select("label", "known")
    return scratch.keep(joined.mapInArrow(run, "label string, words array<string>"), "segments")


def _tokens(scratch: Scratch, keys: DataFrame, unigrams: DataFrame, total: int, seeds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(row, pages, token) without seed words, and (row, seeded): whether a seed word is among the row's."""
    split = lambda c: F.filter(F.split(F.col(c), LETTERS), lambda w: w != "")
    parts = keys.select("row", "pages", F.explode(F.concat(F.transform(split("host"), lambda w: F.struct(F.lit("h:").alias("place"), w.alias("label"))), F.transform(split("shape"), lambda w: F.struct(F.lit("p:").alias("place"), w.alias("label"))))).alias("_p"))
    parts = scratch.keep(parts.select("row", "pages", "_p.place", "_p.label"), "labels_of_rows")
    held = scratch.keep(parts.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), "distinct_labels")
    words = segmented(scratch, held.select("label"), unigrams, total)
    rows = held.agg(F.sum("_n")).first()[0] or 0
    sized = scratch.keep(words.join(scratch.again(held), "label"), "words")
    found = with_label(scratch.again(parts), sized, "label", rows).select("row", "pages", "place", F.explode("words").alias("word"))
    found = scratch.keep(found, "words_of_rows")
    is_seed = F.col("word").isin(*seeds) if seeds else F.lit(False)
    tokens = found.where(~is_seed).select("row", "pages", F.concat("place", "word").alias("token"))
    return tokens, found.where(is_seed).select("row").distinct().withColumn("seeded", F.lit(True))


def learn(scratch: Scratch, keys: DataFrame, tokens: DataFrame, seeded: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row, score: log odds for blocking in millionths. ``keys``: row, pages."""
    marked = scratch.keep(keys.select("row", "pages").join(seeded, "row", "left").withColumn("seeded", F.coalesce("seeded", F.lit(False))), "marked")
    tokens = scratch.keep(tokens, "tokens")
    sizes = scratch.keep(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), F.sum("pages").alias("n")), "token_sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    pages, signs = marked.agg(F.sum("pages"), F.sum(F.when(F.col("seeded"), F.col("pages")))).first()
    pages, signs = pages or 0, signs or 0
    # a page without a sign: as many block as have one, at first nothing else being known
    prior = (signs + 1) / (pages + 2)
    start = math.log(prior / (1 - prior))
    base = F.when(F.col("seeded"), F.lit(math.log(SIGN))).otherwise(F.lit(start))
    q = F.when(F.col("seeded"), SIGN / (SIGN + 1)).otherwise(F.lit(0.0))
    state = scratch.keep(marked.select("row", F.round(q * MICRO).cast("long").alias("q"), F.lit(0).cast("long").alias("score")), "state")
    for _ in range(rounds):
        weighed = tokens.join(state.select("row", "q"), "row")
        counts = weighed.groupBy("token").agg(F.sum(F.col("pages") * F.col("q")).alias("block")).join(sizes, "token")
        block, n = F.col("block") / F.lit(float(MICRO)), F.col("n")
        odds = F.log((block + ALPHA * prior) / (n - block + ALPHA * (1 - prior))) - F.lit(start)
        table = scratch.keep(counts.select("token", F.round(odds * MICRO).cast("long").alias("odds"), "_n"), "odds")
        sums = with_label(scratch.again(tokens).select("row", "token"), table, "token", total).groupBy("row").agg(F.sum("odds").alias("odds"))
        score = F.coalesce("odds", F.lit(0)) + F.round(base * MICRO).cast("long")
        scored = scratch.again(marked).join(sums, "row", "left").withColumn("score", score)
        before, state = state, scratch.keep(scored.select("row", F.round(MICRO / (1 + F.exp(-F.col("score") / MICRO))).cast("long").alias("q"), "score"), "state")
        scratch.drop(before, table)
    return state.select("row", "score")


def judge_urls(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", rules: tuple[tuple[str, str], ...] = RULES, block_seeds: tuple[str, ...] = BLOCK_SEEDS, name_seeds: tuple[str, ...] = NAME_SEEDS
) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds for blocking by the naive Bayes)."""
    scratch = Scratch(pages.sparkSession, "urls")
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    shape = F.regexp_replace(F.lower("path"), LETTERS, " ")
    parted = scratch.keep(with_parts(source).select("page_id", "host", "path", F.trim(shape).alias("shape")), "parts")
    keys = scratch.keep(parted.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages")).withColumn("row", F.monotonically_increasing_id()), "keys")
    seeds = pages.sparkSession.createDataFrame([(w,) for w in dict.fromkeys((*block_seeds, *name_seeds))], "word string")
    text = _text_words(pages, html_col) if html_col and html_col in pages.columns else seeds.select("word", F.lit(0).cast("long").alias("n")).limit(0)
    text = scratch.keep(text, "text_words")
    total = (text.agg(F.sum("n")).first()[0] or 0) + 100_000
    # a seed is as likely as one word in a hundred thousand, or as it is in the text
    unigrams = text.join(seeds.withColumn("seed", F.lit(1)), "word", "full").select("word", F.greatest(F.coalesce("n", F.lit(0)), F.when(F.col("seed") == 1, F.lit(total // 100_000)).otherwise(0)).alias("n"))
    unigrams = scratch.keep(unigrams, "unigrams")
    tokens, seeded = _tokens(scratch, keys, unigrams, total, tuple(block_seeds))
    learned = learn(scratch, scratch.again(keys), tokens, seeded)
    place = F.concat_ws(" ", "host", "shape")
    scored = scratch.keep(scratch.again(keys).join(learned, "row").select(place.alias("_place"), "score", F.col("pages").alias("_n")), "scored")
    rule, verdict = rule_column(rules)
    judged = with_label(scratch.again(parted).withColumn("_place", place), scored, "_place", parted.count())
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), (F.col("score") / MICRO).alias("score"))
