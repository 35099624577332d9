"""Token-bounded chunks of sections, with overlap, exact offsets, locators and stable ids."""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import chunk_id, normalized
from citeloom.operators.index import shared_model

#: Sentence ends, the passage overhead of the word counter, the version in chunk ids.
SENTENCE_ENDS = "\n.؟!؛;"
WORD_OVERHEAD = 3
PIPELINE_VERSION = "1.2.0"
WORDS = re.compile(r"[^\s\x1c-\x1f]+")
#: Sections with longer words than this are not walked by sums over words.
LONG_WORD = 1000
#: How many tokens a slice's count may differ from what its place says.
SLACK = 3


@dataclass(frozen=True)
class ChunkingConfig:
    """Token limits. An overlap that leaves a chunk no room to advance is refused."""

    target: int = 400
    overlap: int = 60
    maximum: int = 480
    overhead: int = WORD_OVERHEAD

    def __post_init__(self) -> None:
        if self.target <= 0 or not 0 <= self.overlap < self.target or not self.target <= self.maximum < 512:
            raise ValueError("need 0 < target <= maximum < 512 and 0 <= overlap < target")
        if self.target - self.overhead - self.overlap <= 0:
            raise ValueError("the overlap leaves no room to advance")


def chunk_words(sections: DataFrame, config: ChunkingConfig = ChunkingConfig(), text: str = "text") -> DataFrame:
    """Chunks by the word counter in closed form: chunk_index (from 0), first_word, n_words, chunk_text, token_count.

    Chunk k starts at word k * step; it is the last one as soon as the rest fits the maximum. All on the section's own row.
    """
    room, step = config.target - config.overhead, config.target - config.overhead - config.overlap
    # words, their number and the last chunk's number are columns of their own: the lambda below refers to them and computes none of them again
    held = sections.withColumn("_w", F.filter(F.split(F.trim(F.col(text)), r"(?U)\s+"), lambda w: w != "")).where(F.size("_w") > 0)
    held = held.withColumn("_n", F.size("_w"))
    more = F.ceil((F.col("_n") + config.overhead - config.maximum) / step)
    held = held.withColumn("_last", F.when(F.col("_n") + config.overhead <= config.maximum, 0).otherwise(more).cast("int"))

    def piece(k: Column) -> Column:
        first = k * step
        n = F.when(k == F.col("_last"), F.col("_n") - first).otherwise(F.lit(room))
        return F.struct(k.alias("chunk_index"), first.alias("first_word"), n.alias("n_words"), F.array_join(F.slice("_w", first + 1, n), " ").alias("chunk_text"))

    cut = held.select(*sections.columns, F.inline(F.transform(F.sequence(F.lit(0), F.col("_last")), piece)))
    return cut.withColumn("token_count", F.col("n_words") + config.overhead)


class TokenPlaces:
    """How many tokens lie before each place of a text, from one tokenisation of its normalised words: a guide for the walk, which counts exactly near it.

    ``starts`` gives the places in a text at which its tokens begin. Words are normalised one by one, so that places in the text and in the
    normalised text correspond word by word; inside a word they correspond in proportion.
    """

    def __init__(self, text: str, start: int, stop: int, starts: Callable[[str], list[int]], reverse_runs: bool = False):
        found = [(m.start(), m.end(), normalized(m.group(), reverse_runs)) for m in WORDS.finditer(text, start, stop)]
        found = [f for f in found if f[2]]
        lengths = np.array([len(f[2]) + 1 for f in found], np.int64)
        begins = np.cumsum(lengths) - lengths
        self.places = np.array([p for a, b, _ in found for p in (a, b)], np.float64)
        ends = np.stack((begins, begins + lengths - 1), axis=1).ravel() if found else np.zeros(0)
        at = np.sort(np.array(starts(" ".join(f[2] for f in found)), np.int64))
        self.tokens = np.searchsorted(at, ends, side="left").astype(np.float64)

    def before(self, place: int) -> float:
        return float(np.interp(place, self.places, self.tokens)) if len(self.places) else 0.0

    def place(self, tokens: float) -> int:
        """About where so many tokens have begun."""
        return int(np.interp(tokens, self.tokens, self.places)) if len(self.places) else 0


class WordTokens(dict):
    """How many tokens each word gives by a counter that takes words one by one; kept for the words seen last."""

    def __init__(self, content: Callable[[str], int], reverse_runs: bool, most: int = 200_000):
        self.content, self.reverse_runs, self.most = content, reverse_runs, most

    def __missing__(self, word: str) -> int:
        n = self.content(word if word.isascii() else normalized(word, self.reverse_runs))
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


class WordSums:
    """Exact counts of a section's slices: sums over its words, of which only those that a slice cuts are counted anew.

    Words are what lies between white space, by which neither normalisation nor such a counter looks across.
    """

    def __init__(self, text: str, start: int, stop: int, tokens: WordTokens):
        self.text, self.tokens = text, tokens
        words = WORDS.findall(text, start, stop)
        self.longest = max(map(len, words), default=0)
        self.begins = [m.start() for m in WORDS.finditer(text, start, stop)]
        self.stops = list(map(int.__add__, self.begins, map(len, words)))
        # a section with long words is left to the other walks
        self.sums = [0, *accumulate(map(tokens.__getitem__, words))] if self.longest <= LONG_WORD else []

    def count(self, a: int, e: int) -> int:
        i, j = bisect_right(self.stops, a), bisect_left(self.begins, e)
        if i >= j:
            return 0
        first, last = max(a, self.begins[i]), min(e, self.stops[j - 1])
        if i == j - 1:
            return self.tokens[self.text[first:last]]
        total = self.sums[j] - self.sums[i]
        if first > self.begins[i]:
            total += self.tokens[self.text[first : self.stops[i]]] - (self.sums[i + 1] - self.sums[i])
        if last < self.stops[j - 1]:
            total += self.tokens[self.text[self.begins[j - 1] : last]] - (self.sums[j] - self.sums[j - 1])
        return total

    def reached(self, start: int, room: int) -> int:
        """The number of the first word with which the slice from ``start`` goes beyond the room; how many words there are if none does."""
        i = bisect_right(self.stops, start)
        whole = self.sums[i] if i < len(self.begins) and self.begins[i] < start else None
        if whole is None:
            return bisect_right(self.sums, self.sums[i] + room) - 1
        cut = self.tokens[self.text[start : self.stops[i]]]
        return i if cut > room else bisect_right(self.sums, self.sums[i + 1] - cut + room) - 1

    def opened(self, end: int, room: int) -> int:
        """The number of the first word from which on the slice up to ``end`` stays within the room."""
        j = bisect_left(self.begins, end)
        if j and self.stops[j - 1] > end:
            cut = self.tokens[self.text[self.begins[j - 1] : end]]
            return j if cut > room else bisect_left(self.sums, self.sums[j - 1] + cut - room, 0, j - 1)
        return bisect_left(self.sums, self.sums[j] - room, 0, j)


class Walk:
    """The general walk over one section for any token counter, in code points of the record's text.

    Tokens are those of the normalised slice, as it is indexed. Counts are taken not to fall as a slice grows, so the search for the end starts near the
    slice's beginning, and a long section costs no more per chunk than a short one. With ``starts`` (see TokenPlaces) the section is tokenised once, and
    slices are counted only near the places that this points to. With ``words`` (see WordSums: tokens of one normalised word, for counters that take words
    one by one) each word is counted once and slices are sums, exactly; only a section with words of over LONG_WORD characters is walked as before.
    """

    def __init__(self, passage: Callable[[str], int], content: Callable[[str], int], config: ChunkingConfig, reverse_runs: bool = False, starts: Callable[[str], list[int]] | None = None, words: Callable[[str], int] | None = None):
        self.config, self.reverse_runs, self.starts, self.guide = config, reverse_runs, starts, None
        self.overhead = passage("a") - content("a")
        self.passage = lambda text: passage(normalized(text, reverse_runs))
        self.content = lambda text: content(normalized(text, reverse_runs))
        self.words, self.sums = WordTokens(words, reverse_runs) if words else None, None

    def _last_fit(self, fits: Callable[[int], bool], low: int, high: int, guess: int) -> int:
        """The largest place in low..high that fits, or low - 1; ``fits`` holds up to some place and not beyond. The search widens from the guess."""
        guess, step = min(max(guess, low), high), 8
        if fits(guess):
            low = guess + 1
            while low <= high and fits(min(high, low + step)):
                low, step = min(high, low + step) + 1, 4 * step
            high = min(high, low + step) - 1 if low <= high else high
        else:
            high = guess - 1
            while low <= high and not fits(max(low, high - step)):
                high, step = max(low, high - step) - 1, 4 * step
            low = max(low, high - step) + 1 if low <= high else low
        while low <= high:
            middle = (low + high) // 2
            if fits(middle):
                low = middle + 1
            else:
                high = middle - 1
        return low - 1

    def _tokens(self, text: str, start: int, end: int) -> int:
        return self.overhead + self.sums.count(start, end) if self.sums else self.passage(text[start:end])

    def _end(self, text: str, start: int, stop: int, breaks: list[int]) -> int:
        fits = lambda e: self._tokens(text, start, e) <= self.config.maximum
        if self.sums and self.config.maximum - self.config.target >= 2 * SLACK:
            # every slice up to this word fits the target and none beyond it does; white space before it is an end
            if fits(stop):
                return stop
            at = self.sums.reached(start, self.config.target - self.overhead)
            low, high = max(start, self.sums.begins[at]), self.sums.stops[at]
            inside = self._ends(text, low, high, breaks)[:-1]
            found = next((e for e in reversed(inside) if self._tokens(text, start, e) <= self.config.target), low)
            if found > start:
                return found
        if self.guide and self.guide.before(stop) - self.guide.before(start) <= self.config.maximum - self.overhead + SLACK and fits(stop):
            return stop
        if self.guide and self.config.maximum - self.config.target >= 2 * SLACK:
            # the hard end matters only where no end reaches the target
            base = self.guide.before(start) - self.overhead
            low, high = (min(stop, max(start, self.guide.place(base + n))) for n in (self.config.target - SLACK, self.config.maximum - SLACK))
            likely = [e for e in self._ends(text, max(start, low - 1), high, breaks)[:-1] if self.guide.before(e) - base <= self.config.target + SLACK] if high > start else []
            found = next((e for e in reversed(likely) if self.passage(text[start:e]) <= self.config.target), None)
            if found is not None:
                return found
        if self.guide:
            hard = self._last_fit(fits, start + 1, stop, self.guide.place(self.guide.before(start) + self.config.maximum - self.overhead))
        else:
            low, step = start, 256
            high = min(stop, start + step)
            while high < stop and fits(high):
                low, step = high, 2 * step
                high = min(stop, start + step)
            hard = self._last_fit(fits, low + 1, high, (low + high) // 2)
        if hard < stop and self.config.maximum - self.config.target < SLACK:
            # an end inside a word can be taken: counts may fall there for a few characters
            while more := next((d for d in range(1, 49) if hard + d <= stop and fits(hard + d)), 0):
                hard += more
        if hard == start:
            raise ValueError("one character exceeds the token maximum")
        if hard == stop:
            return stop
        first = start
        if self.guide:
            # ends well below the target fit; candidates are tried from a little above it
            first = max(start, self.guide.place(self.guide.before(start) + self.config.target - self.overhead - SLACK) - 1)
        ends = self._ends(text, first, hard, breaks)
        if self.guide:
            above = self.guide.before(start) + self.config.target - self.overhead + SLACK
            likely = [e for e in ends if self.guide.before(e) <= above]
            found = next((e for e in reversed(likely) if self.passage(text[start:e]) <= self.config.target), None)
            if found is not None:
                return found
            ends = self._ends(text, start, hard, breaks)
        return next((e for e in reversed(ends) if self._tokens(text, start, e) <= self.config.target), hard)

    @staticmethod
    def _ends(text: str, start: int, hard: int, breaks: list[int]) -> list[int]:
        """Where a chunk may end: behind sentence ends and white space, at preferred breaks, and at the hard end."""
        after = {i + 1 for i in range(start, hard) if text[i] in SENTENCE_ENDS or text[i].isspace()}
        return sorted(after | set(breaks[bisect_right(breaks, start) : bisect_right(breaks, hard)]) | {hard})

    def _start(self, text: str, first: int, end: int) -> int:
        if not self.config.overlap:
            return end
        if self.sums:
            at = self.sums.opened(end, self.config.overlap)
            return min(end, self.sums.stops[at - 1] + 1) if at else first
        fits = lambda a: self.content(text[a:end]) <= self.config.overlap
        # starts behind white space; the first that fits
        size = 64 if not self.guide else 64 + end - max(first, min(end, self.guide.place(self.guide.before(end) - self.config.overlap)))
        while True:
            low = max(first, end - size)
            starts = [i for i in range(max(low, first + 1), end) if text[i - 1].isspace()]
            if low == first:
                starts = [first, *starts]
            if low == first or (starts and not fits(starts[0])):
                break
            size *= 2
        at = bisect_left(starts, True, key=fits)
        return starts[at] if at < len(starts) else end

    def spans(self, text: str, start: int, stop: int, breaks: list[int]) -> Iterator[tuple[int, int, str, int]]:
        """Trimmed spans of the section's chunks in turn, with their normalised texts and tokens. Chunks that normalise to nothing are left out."""
        first, at = start, start
        self.sums = WordSums(text, start, stop, self.words) if self.words is not None else None
        if self.sums and self.sums.longest > LONG_WORD:
            self.sums = None
        self.guide = TokenPlaces(text, start, stop, self.starts, self.reverse_runs) if self.starts and not self.sums else None
        while at < stop:
            end = self._end(text, at, stop, breaks)
            a, b = at, end
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            form = normalized(text[a:b], self.reverse_runs)
            if form:
                tokens = self._tokens(text, a, b)
                if tokens > self.config.maximum:
                    raise ValueError(f"a chunk of {tokens} tokens exceeds the maximum of {self.config.maximum}")
                yield a, b, form, tokens
            if end == stop:
                return
            at = max(at + 1, self._start(text, first, end))


#: What makes a counter in a task: (tokens of a passage, tokens of the content alone), and if it can, (places where a text's tokens begin).
Counter = Callable[[], tuple]


def word_counter() -> tuple:
    content = lambda t: len(t.split())
    content.word_by_word = True
    return lambda t: len(t.split()) + WORD_OVERHEAD, content


#: Normalisers of tokenizers that change each word by itself, and first steps that leave white space out and cut each word by itself.
OWN_NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
OWN_SPLITS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
SPACES_TO_ONE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def takes_words_one_by_one(held) -> bool:
    """If a tokenizer's tokens of a text are those of its words, by what it is made of; false where that is not certain."""

    def steps(part, several: str) -> list[dict]:
        state = json.loads(part.__getstate__()) if part is not None else {"type": "Sequence", several: []}
        return state[several] if state["type"] == "Sequence" else [state]

    if held.truncation or held.padding or any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in held.get_added_tokens_decoder().values()):
        return False
    if not all(n["type"] in OWN_NORMALIZERS or n == SPACES_TO_ONE for n in steps(held.normalizer, "normalizers")):
        return False
    first = next(iter(steps(held.pre_tokenizer, "pretokenizers")), {"type": ""})
    return first["type"] in OWN_SPLITS or first == {"type": "Split", "pattern": {"Regex": WORD_PARTS}, "behavior": "Removed", "invert": True}


def _counts(held, prefix: str) -> tuple:
    starts = lambda t: [a for a, _ in held.encode(t, add_special_tokens=False).offsets]
    content = lambda t: len(held.encode(t, add_special_tokens=False).ids)
    # a prefix without white space behind it would grow together with the first word
    content.word_by_word = (not prefix or prefix[-1].isspace()) and takes_words_one_by_one(held)
    return lambda t: len(held.encode(prefix + t).ids), content, starts


def tokenizer_counter(path: str, prefix: str = "passage: ") -> Counter:
    """A counter by a local tokenizer file: with prefix and special tokens, and of the content alone. Its name is the file's absolute path."""

    def make() -> tuple:
        from tokenizers import Tokenizer

        return _counts(shared_model(path, lambda: Tokenizer.from_file(path)), prefix)

    make.tokenizer_name = os.path.abspath(path)
    return make


def hub_tokenizer_counter(name: str, revision: str, prefix: str = "passage: ") -> Counter:
    """A counter by a tokenizer of a model hub, at a fixed revision, read once per process. Its name is ``name@revision``."""

    def make() -> tuple:
        from tokenizers import Tokenizer

        return _counts(shared_model(f"{name}@{revision}", lambda: Tokenizer.from_pretrained(name, revision=revision)), prefix)

    make.tokenizer_name = f"{name}@{revision}"
    return make


def counter_name(counter: Callable) -> str:
    """What chunks and reports call a token counter."""
    return getattr(counter, "tokenizer_name", "words")


def task_walks(counter: Counter, config: ChunkingConfig) -> list[Walk]:
    """The walks of a task, over texts as they are and with digit runs turned."""
    passage, content, *starts = counter()
    words = content if getattr(content, "word_by_word", False) else None
    return [Walk(passage, content, config, turned, *starts, words=words) for turned in (False, True)]


def chunk_spans(sections: DataFrame, counter: Counter = word_counter, config: ChunkingConfig = ChunkingConfig(), text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Chunks of sections by any counter: the columns ``keep``, and chunk_in_section, chunk_start, chunk_end, chunk_text, normalized_chunk, token_count.

    One row per chunk, in order per section. ``counter`` is called once per task. Needs start_char, end_char and preferred_breaks. The section's
    text ends here: a chunk's row holds its own slice.
    """
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sections.select(*keep).schema)
    made = ("chunk_in_section", "chunk_start", "chunk_end", "chunk_text", "normalized_chunk", "token_count")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = task_walks(counter, config)[0]
        for frame in frames:
            out = []
            for held, start, stop, breaks, *own in frame.itertuples(index=False, name=None):
                out += [(*own, k, a, b, held[a:b], form, tokens) for k, (a, b, form, tokens) in enumerate(walk.spans(held, start, stop, list(breaks)))]
            yield pd.DataFrame(out, columns=[*keep, *made])

    given = sections.select(text, "start_char", "end_char", "preferred_breaks", *keep)
    return given.mapInPandas(run, fields + "chunk_in_section int, chunk_start int, chunk_end int, chunk_text string, normalized_chunk string, token_count int")


RECORD_CHUNK = (
    "document_id string, record_no int, chunk_no int, section_type string, section_title string, chunk_start int, chunk_end int, locator_start int, locator_end int, "
    "original_text string, normalized_text string, token_count int, chunk_error string"
)


def chunk_record_sections(records: DataFrame, counter: Counter = word_counter, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks of whole records (document_id, record_no, original_text, locator_start, locator_end, segment_starts, segment_ends, reversed_runs, sections): the columns of
    RECORD_CHUNK, in the record's order.

    A record's text, its segments and its sections come as one row and end here: slices and locators are made on the spot, so that what goes on is the chunks
    alone. A section that cannot be cut is one row with its fault in chunk_error.
    """
    names = [f.split()[0] for f in RECORD_CHUNK.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks = task_walks(counter, config)
        for frame in frames:
            out = []
            for document, record, text, first, last, starts, ends, turned, sections in frame.itertuples(index=False, name=None):
                found, walk = [], walks[bool(turned)]
                for section in sections:
                    own = (section["section_type"], section["section_title"])
                    try:
                        found += [(*own, *span, None) for span in walk.spans(text, section["start_char"], section["end_char"], list(section["preferred_breaks"]))]
                    except ValueError as error:
                        found.append((*own, None, None, None, None, str(error)))
                whole = [f for f in found if f[2] is not None]
                low, high = locators(np.asarray(starts), np.asarray(ends), np.array([f[2] for f in whole]), np.array([f[3] for f in whole]))
                places = iter(zip(low.tolist(), high.tolist()))
                for k, (kind, title, a, b, form, tokens, error) in enumerate(found):
                    i, j = next(places) if error is None else (1, 0)
                    place = (first, last) if i > j else (i + 1, j + 1)
                    out.append((document, record, k, kind, title, a, b, *place, None if error else text[a:b], form, tokens, error))
            made = pd.DataFrame(out, columns=names)
            yield made.astype({n: "Int32" for n in ("chunk_start", "chunk_end", "token_count")})

    given = records.select("document_id", "record_no", "original_text", "locator_start", "locator_end", "segment_starts", "segment_ends", "reversed_runs", "sections")
    return given.mapInPandas(run, RECORD_CHUNK)


def locators(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last of consecutive segments that spans overlap, from 0; first > last for a span that meets none."""
    return np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, end, side="left") - 1


def locate_spans(rows: DataFrame, keep: Sequence[str], segments: str = "segments", spans: str = "spans") -> DataFrame:
    """One row per span: the columns ``keep``, span_no (from 0), start_char, end_char, locator_start, locator_end (from 1; null for a span that meets no segment).

    ``segments`` and ``spans`` are arrays of structs with start_char and end_char; segments follow each other. Each span is found by two binary searches,
    so a row costs its segments and spans, not their product.
    """
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)

    def parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = lists.flatten()
        return lists.offsets.to_numpy() - lists.offsets[0].as_py(), flat.field("start_char").to_numpy(), flat.field("end_char").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, starts, ends), (to, begin, end) = parts(batch.column(0)), parts(batch.column(1))
            found = [locators(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], begin[to[i] : to[i + 1]], end[to[i] : to[i + 1]]) for i in range(batch.num_rows)]
            first, last = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), ())))
            row = np.repeat(np.arange(batch.num_rows), np.diff(to))
            none = first > last
            own = [batch.column(2 + k).take(pa.array(row)) for k in range(len(keep))]
            columns = [np.arange(len(row)) - to[row], begin, end, first + 1, last + 1]
            masks = [None, None, None, none, none]
            arrays = [pa.array(c.astype(np.int32), pa.int32(), mask=m) for c, m in zip(columns, masks)]
            yield pa.RecordBatch.from_arrays([*own, *arrays], [*keep, "span_no", "start_char", "end_char", "locator_start", "locator_end"])

    pair = "array<struct<start_char:int,end_char:int>>"
    narrow = [F.transform(c, lambda s: F.struct(s["start_char"].cast("int").alias("start_char"), s["end_char"].cast("int").alias("end_char"))).cast(pair).alias(c) for c in (segments, spans)]
    return rows.select(*narrow, *keep).mapInArrow(run, fields + "span_no int, start_char int, end_char int, locator_start int, locator_end int")


def stable_chunk_id(document: Column, version: Column, source_format: Column, locator_type: Column, locator_start: Column, locator_end: Column, start: Column, end: Column, section_type: Column, title: Column) -> Column:
    return chunk_id(document, version, F.lit(PIPELINE_VERSION), source_format, locator_type, locator_start, locator_end, start, end, section_type, title)
