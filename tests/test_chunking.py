"""Chunks, sections and locators of long inputs against their plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators import chunking, structure
from citeloom.plans import pipeline

WORDS = ("law", "article", "notice", "two-thirds", "3.5", "المادة", "الإيجـــار", "مُشَكَّل", "ﬁne", "é", "a.b.c", "‏", "日本", "unquestionably", "(12)", "؛", "«x»", "!?", "٣٫٥")


def prose(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice((" ", " ", " ", "  ", "\n", ". ", "؛ ", " ", "")) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sizes", [(30, 5, 36), (60, 20, 70), (24, 0, 40)])
def test_a_guided_walk_cuts_where_the_plain_one_does(seed, sizes):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    config, source = chunking.ChunkingConfig(*sizes), prose(seed, 400)
    breaks = sorted(random.Random(seed).sample(range(len(source)), 20))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        passage, content, starts = chunking.tokenizer_counter(public_tokenizers.path(name))()
        for turned in (False, True):
            plain = chunking.Walk(passage, content, config, turned)
            guided = chunking.Walk(passage, content, config, turned, starts)
            assert list(guided.spans(source, 7, len(source) - 3, breaks)) == list(plain.spans(source, 7, len(source) - 3, breaks))


def test_a_guided_walk_counts_few_slices():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    passage, content, starts = chunking.tokenizer_counter(public_tokenizers.path("word_bpe_49k.json"))()
    asked = {False: 0, True: 0}
    source = prose(1, 6000)
    for guided in (False, True):
        def count(t, guided=guided):
            asked[guided] += len(t)
            return passage(t)
        found = list(chunking.Walk(count, content, chunking.ChunkingConfig(), starts=starts if guided else None).spans(source, 0, len(source), []))
    assert asked[True] * 2 < asked[False] and asked[True] < 60 * sum(len(f[2]) for f in found)


def test_long_texts_cost_as_much_as_short_ones(spark):
    words = " ".join(f"w{i % 977}" for i in range(160_000)).split()
    one = spark.createDataFrame([(0, " ".join(words))], "id int, text string")
    many = spark.createDataFrame([(i, " ".join(words[i * 1000 : (i + 1) * 1000])) for i in range(160)], "id int, text string").coalesce(1)
    took = {}
    for name, rows in (("warm", many), ("many", many), ("one", one)):
        began = time.perf_counter()
        n = chunking.chunk_words(rows).select(F.sum(F.length("chunk_text"))).first()[0]
        took[name] = time.perf_counter() - began
        assert n > 700_000
    # quadratic work took forty times as long
    assert took["one"] < 3 * took["many"] + 1.0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_scans_in_two_levels(spark, block):
    rng = random.Random(block)
    rows = [(d, k, rng.choice((None, None, f"h{d}.{k}")), rng.randrange(5)) for d in range(4) for k in sorted(rng.sample(range(40), 25))]
    held = spark.createDataFrame(rows, "d int, k int, head string, n int").repartition(5)
    carried = {(r.d, r.k): r.before for r in structure.carry_last(held, "d", "k", "head", "before", block).collect()}
    summed = {(r.d, r.k): r.before for r in structure.running_before(held, "d", "k", "n", "before", block).collect()}
    for d in range(4):
        last, total = None, 0
        for _, k, head, n in [r for r in rows if r[0] == d]:
            assert carried[d, k] == last and summed[d, k] == total
            last, total = head or last, total + n


@pytest.mark.parametrize("block", [2, 1000])
def test_sections_of_a_document_in_many_tasks(spark, block):
    rng = random.Random(4)
    lines = ["PART I Scope", "Article 5 Terms", "المادة (3) تعريف", "الفصل الثاني", "plain words", "", "  ", "1. clause of it", "Chapter 2", "more prose\r"]
    pages = [(d, k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for d in range(3) for k in range(20)]
    found = structure.detect_sections(spark.createDataFrame(pages, "doc_id int, record_no int, text string").repartition(7), block=block).collect()
    wanted = []
    for d in range(3):
        head = None
        for _, k, source in [p for p in pages if p[0] == d]:
            if not source.strip():
                continue
            sections, last = structure.sections_of(source)
            for s in sections:
                own = (s["section_type"], s["section_title"]) if s["section_no"] else (head["section_type"], head["title"]) if head else ("document", None)
                wanted.append((d, k, s["section_no"], s["start_char"], s["end_char"], *own, tuple(s["preferred_breaks"])))
            head = last or head
    assert sorted((r.doc_id, r.record_no, r.section_no, r.start_char, r.end_char, r.section_type, r.section_title, tuple(r.preferred_breaks)) for r in found) == sorted(wanted)


def test_kinds_of_lines_agree_with_the_columns(spark):
    from citeloom.plans import fixtures

    lines = [t for _, t in fixtures.LINES] + ["PARTS of", "part", "Section 5", "ARTICLE", "article(12 bis)", "مادة", "المادة12", "الباب", "البابان", "a - x", "١) y", "٣ . z", "Ｐａｒｔ II", "ſection 4", "1)", "1) ", "(a) b", "B: c"]
    frame = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    columns = {r.k: tuple(r.c) for r in frame.select("k", structure.classify(F.col("line")).alias("c")).collect()}
    for k, line in enumerate(lines):
        assert structure.kind_of(text.normalized(line).strip()) == columns[k], line


def test_a_million_lines_are_located_in_linear_time():
    starts = np.arange(1_000_000) * 10
    begin = np.arange(0, 10_000_000 - 400, 337)
    began = time.perf_counter()
    first, last = chunking.locators(starts, starts + 10, begin, begin + 397)
    assert time.perf_counter() - began < 5 and (first == begin // 10).all() and (last == (begin + 396) // 10).all()


def test_many_lines_in_one_record(spark):
    source = "word and words\n" * 60_000
    began = time.perf_counter()
    records = spark.createDataFrame([("d", "txt", "line", 1, 60_000, source, "en")], "document_id string, source_format string, locator_type string, locator_start int, locator_end int, original_text string, language string")
    from citeloom.sources.documents import line_places

    chunks = pipeline.chunk_records(records.withColumn("source_segments", line_places("original_text")))
    found = chunks.orderBy("chunk_index").collect()
    assert time.perf_counter() - began < 90
    assert [c.chunk_index for c in found] == list(range(len(found))) and found[-1].locator_end == 60_000
    assert all(source[c.chunk_start : c.chunk_end] == c.original_text and len(c.original_text) < 3000 for c in found[:50])
    assert found[1].locator_start == found[1].chunk_start // 15 + 1
    # the record's text and segments end in the walk
    assert not {"source_segments", "segment_starts", "sections", "preferred_breaks"} & set(chunks.columns)


def test_chunk_numbers_run_through_a_document(spark):
    pages = [("d", "pdf", "page", k, k, f"Article {k} Terms\n" + "some words of the page " * (40 * (k % 3 + 1)), "en", k) for k in range(1, 8)]
    records = spark.createDataFrame(pages, "document_id string, source_format string, locator_type string, locator_start int, locator_end int, original_text string, language string, page_number int")
    records = records.withColumn("source_segments", F.array().cast("array<struct<start_char:int,end_char:int,locator_start:int,locator_end:int,kind:string>>"))
    found = pipeline.chunk_records(records, config=chunking.ChunkingConfig(60, 10, 70)).orderBy("chunk_index").collect()
    assert [c.chunk_index for c in found] == list(range(len(found)))
    assert [c.page_start for c in found] == sorted(c.page_start for c in found) and all(c.locator_start == c.page_start for c in found)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sizes", [(30, 5, 36), (60, 20, 70), (24, 0, 40), (30, 5, 32)])
def test_sums_over_words_cut_where_the_plain_walk_does(seed, sizes):
    counters = [chunking.word_counter]
    if public_tokenizers := pytest.importorskip("public_tokenizers"):
        counters.append(chunking.tokenizer_counter(public_tokenizers.path("word_bpe_49k.json")))
    config, source = chunking.ChunkingConfig(*sizes), prose(seed, 400) + ("ab.c" * 120, "x" * 1200 + " y.z" * 50, "")[seed]
    breaks = sorted(random.Random(seed).sample(range(len(source)), 20))
    cut = lambda walk: list(walk.spans(source, 7, len(source) - 3, breaks))
    for counter in counters:
        passage, content, *_ = counter()
        for turned, walk in zip((False, True), chunking.task_walks(counter, config)):
            plain = chunking.Walk(passage, content, config, turned)
            try:
                wanted = cut(plain)
            except ValueError as error:
                with pytest.raises(ValueError, match=str(error)):
                    cut(walk)
            else:
                assert cut(walk) == wanted


def test_each_word_is_counted_about_once():
    asked = [0]

    def content(t):
        asked[0] += len(t)
        return len(t.split())

    content.word_by_word = True
    source = prose(1, 6000)
    walk = chunking.task_walks(lambda: (lambda t: content(t) + 3, content), chunking.ChunkingConfig())[0]
    assert len(list(walk.spans(source, 0, len(source), []))) > 10
    # each end and start was searched with counts of whole slices before: some hundred times the text
    assert asked[0] < len(source)


def test_only_tokenizers_known_to_take_words_one_by_one_are_summed():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    held = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
    assert [chunking.takes_words_one_by_one(t) for t in held.values()] == [True, False]
    held["word_bpe_49k.json"].add_tokens(["two words"])
    assert not chunking.takes_words_one_by_one(held["word_bpe_49k.json"])
