"""Operators on literal rows: text, chunks, sources, index, answers, settings."""

from __future__ import annotations

import io
import random
import unicodedata
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import numbers, text
from citeloom.operators import answers, chunking, gate, index, retrieval, structure
from citeloom.sources import documents
from citeloom.sources.settings import Settings, load_settings


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_normalisation(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="ﻻ  عـــربيّ\u200f\r\n\n أإآ ىیک \ue000x") == "لا عربي\nااا ييك x"
    assert one(spark, text.normalize_text(F.col("t"), True), t="a ١٢٣۴") == "a ۴٣٢١"
    assert one(spark, text.normalize_text(F.col("t")), t=None) is None


def test_language_and_ocr(spark):
    for given, wanted in (("مرحبا بالعالم", "ar"), ("hello there", "en"), ("مرحبا hello", "mixed"), ("12", "unknown"), ("", "unknown"), (None, "unknown")):
        assert one(spark, text.detect_language(text.text_quality(F.col("t"))), t=given) == wanted
    assert one(spark, text.requires_ocr(text.text_quality(F.col("t")), "en"), t="a" * 49)
    assert not one(spark, text.requires_ocr(text.text_quality(F.col("t")), "en"), t="a" * 50)
    assert one(spark, text.requires_ocr(text.text_quality(F.col("t")), "en"), t="a" * 97 + "\ufffd" * 2)


def test_latin_class_is_by_name():
    import re

    ranges = re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", text.latin_class())
    inside = lambda c: any(int(a, 16) <= ord(c) <= int(b, 16) for a, b in ranges)
    assert inside("é") and inside("ß") and not inside("1") and not inside("ж")
    assert all(inside(chr(c)) == (chr(c).isalpha() and "LATIN" in unicodedata.name(chr(c), "")) for c in range(0x300))


def test_uuid5(spark):
    assert one(spark, text.uuid5(F.col("t")), t="chunk:é1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:é1"))


def test_numbers(spark):
    assert one(spark, numbers.numbers(F.col("t")), t="1,000 and ٣،٥ and 3.0. 1000") == ["1000", "35", "3.0"]
    assert one(spark, numbers.million_values(F.col("t")), t="5 million, خمسة ملايين") == ["5 million"]
    assert one(spark, numbers.threshold_values(F.col("t")), t="لا تتجاوز 5 مليون و 6 million") == ["5 million"]
    assert one(spark, numbers.number_words(F.col("t")), t="ثلاثة ثم عشرة") == ["3", "10"]


def test_chunk_walk_agrees_with_the_closed_form(spark):
    random.seed(3)
    config = chunking.ChunkingConfig(30, 5, 36)
    texts = [" ".join(random.choice(("ab", "cde", "f")) for _ in range(random.randint(1, 150))) for _ in range(40)]
    sections = spark.createDataFrame([(i, t, 0, len(t)) for i, t in enumerate(texts)], "id int, text string, start_char int, end_char int").withColumn("preferred_breaks", F.array().cast("array<int>"))
    walked = chunking.chunk_spans(sections, config=config, keep=["id"]).select("id", F.col("chunk_in_section").alias("k"), F.col("chunk_text").alias("t"))
    closed = chunking.chunk_words(sections.select("id", "text"), config).select("id", F.col("chunk_index").alias("k"), F.col("chunk_text").alias("t"))
    assert sorted(map(tuple, walked.collect())) == sorted(map(tuple, closed.collect()))


@pytest.mark.parametrize("limits", [(0, 0, 10), (10, 10, 12), (10, 2, 9), (400, 60, 512), (6, 5, 7)])
def test_chunk_limits_are_checked(limits):
    with pytest.raises(ValueError):
        chunking.ChunkingConfig(*limits)


def test_sections_carry_headings_over_pages(spark):
    pages = [(1, 1, "Intro\nPART I\nbody\n"), (1, 2, "more\nArticle 5 Terms\n1. clause\n\nend"), (1, 3, ""), (1, 4, None), (1, 5, "tail")]
    found = structure.detect_sections(spark.createDataFrame(pages, "doc_id int, record_no int, text string")).orderBy("record_no", "section_no").collect()
    assert [(r.record_no, r.section_type, r.section_title, r.start_char, r.end_char) for r in found] == [
        (1, "document", None, 0, 6), (1, "part", "PART I", 6, 18), (2, "part", "PART I", 0, 5), (2, "article", "Article 5", 5, 35), (5, "article", "Article 5", 0, 4)
    ]
    assert list(found[3].preferred_breaks) == [21, 32]


def test_locators(spark):
    get = lambda a, b: tuple(int(x[0]) for x in chunking.locators(np.array([0, 5]), np.array([5, 9]), np.array([a]), np.array([b])))
    assert get(0, 5) == (0, 0) and get(4, 6) == (0, 1) and get(5, 9) == (1, 1) and get(9, 12) == (2, 1)
    rows = spark.createDataFrame([(1, [(0, 5), (5, 9)], [(0, 5), (4, 6), (9, 12)]), (2, [], [(0, 3)]), (3, [(0, 2)], [])], "id int, segments array<struct<start_char:int,end_char:int>>, spans array<struct<start_char:bigint,end_char:bigint>>")
    found = chunking.locate_spans(rows, ["id"]).collect()
    assert sorted((r.id, r.span_no, r.start_char, r.end_char, r.locator_start, r.locator_end) for r in found) == [(1, 0, 0, 5, 1, 1), (1, 1, 4, 6, 1, 2), (1, 2, 9, 12, None, None), (2, 0, 0, 3, None, None)]


def docx(paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" if isinstance(p, str) else f"<w:tbl><w:tr>{''.join(map(cell, p))}</w:tr></w:tbl>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_to_chunks(spark, tmp_path):
    from citeloom.plans.pipeline import ingest

    (tmp_path / "a.txt").write_bytes("\ufeffArticle 1 Scope\nplain words here\r\nmore".encode())
    (tmp_path / "b.docx").write_bytes(docx(["First", ("x", "y"), "Last"]))
    (tmp_path / "c.txt").write_bytes(b"bad\0")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    (tmp_path / "f.PDF").write_bytes(b"no pdf")
    (tmp_path / "g.md").write_bytes(b"other")
    files = documents.validate(documents.scan_files(spark, str(tmp_path)))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in files.select("path", "error").collect()}
    assert errors == {"a.txt": None, "b.docx": None, "c.txt": "text holds NUL", "d.txt": "text is not UTF-8", "e.docx": "not a Word file", "f.PDF": "no PDF header"}
    good = files.where("error IS NULL")
    records = documents.text_records(good).unionByName(documents.word_records(good))
    held = {r.source_format: r for r in records.collect()}
    assert held["docx"].original_text == "First\nx\ty\nLast\n" and [s.kind for s in held["docx"].source_segments] == ["paragraph", "table_row", "paragraph"]
    assert [(s.start_char, s.end_char) for s in held["txt"].source_segments] == [(0, 16), (16, 34), (34, 38)]
    chunks = ingest(records).collect()
    assert {(c.source_format, c.section_type, c.locator_start, c.locator_end) for c in chunks} == {("txt", "article", 1, 3), ("docx", "document", 1, 3)}
    assert len({c.chunk_id for c in chunks}) == 2 and all(len(c.vector) == 64 for c in chunks)


def test_empty_file_is_an_error(spark):
    row = spark.createDataFrame([("h.txt", "txt", 0, bytearray(b""))], "path string, source_format string, length long, content binary")
    assert documents.validate(row).first()["error"] == "file is empty"


def test_pages_and_ocr(spark):
    files = spark.createDataFrame([("p1", "pdf", bytearray(b"%PDF-1"), "d1")], "path string, source_format string, content binary, document_id string")
    pages = documents.page_records(files, lambda content, limit: ["x" * 60, "", "", "", "late"], page_limit=4, expected="en")
    assert [r.needs_ocr for r in pages.orderBy("page_number").collect()] == [False, True, True, True]

    def engine(document, page, language):
        if page == 3:
            raise RuntimeError("broken page")
        return ("m" * 60 if language == "en" and page < 4 else "short", 0.9)

    read = documents.choose_ocr(pages, engine).orderBy("page_number").collect()
    assert [r.extraction_method for r in read] == ["native", "ocr", "failed", "failed"] and read[2].error == "RuntimeError: broken page" and "quality" in read[3].error
    assert documents.ocr_text([("a ", 0.9), ("b", 0.2), (" ", 0.8), ("c", 0.5)]) == ("a\nc", 0.7) and documents.ocr_text([]) == ("", None)
    assert documents.line_engine(lambda d, p, l, dpi: [(f"{dpi}", 1.0)])("d", 1, "ar") == ("220", 1.0)


def make_pdf(pages):
    """Stands for a PDF: pages of lines, as read_pages gives them back."""
    return b"%PDF-1.4\n" + b"\f".join("\n".join(lines).encode() for lines in pages)


def read_pages(content, limit):
    if not content[9:]:
        raise ValueError("PDF holds nothing")
    return [documents.Page(p.decode()) for p in content[9:].split(b"\f")][:limit]


def test_plain_twins_agree_with_columns(spark):
    rng = random.Random(2)
    signs = "aZé ßﬁﬀ\u200f\u0640ـَُ١٢۴٣أإىکي \t\n\r\x0b\x1c\x1f\x85\u2028\xa0\ue000\ufffd\u3000Ａ12.,"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["plain  ascii \n\n x ", ""]
    rows = spark.createDataFrame([(t, bool(i % 2)) for i, t in enumerate(texts)], "t string, r boolean")
    found = rows.select("t", "r", text.normalize_text(F.col("t"), F.col("r")).alias("n"), text.text_quality(F.col("t")).alias("q"), text.detect_language(text.text_quality(F.col("t"))).alias("l"), text.requires_ocr(text.text_quality(F.col("t")), "auto").alias("o")).collect()
    for r in found:
        assert r.n == text.normalized(r.t, r.r), r.t
        mine = text.quality_of(r.t)
        assert all(abs(mine[k] - r.q[k]) < 1e-9 for k in mine), (r.t, mine, r.q)
        assert text.language_of(mine) == r.l and text.needs_ocr(mine, "auto") == r.o


def test_answers_are_parsed_strictly(spark):
    good = '{"answer": "x", "evidence_ids": ["E1"]%s}'
    bad = ['{"answer": 5, "evidence_ids": []}', '{"answer": true, "evidence_ids": []}', '{"answer": {"a": 1}, "evidence_ids": []}', good % "" + " more", good % "" + good % "", good % ', "insufficient_evidence": null', good % ', "insufficient_evidence": 2', good % ', "insufficient_evidence": "maybe"', good % ', "k": 1', '{"answer": "", "evidence_ids": []}', '{"answer": "x"}', '{"answer": "x", "evidence_ids": null}', '{"answer": "x", "evidence_ids": [1]}', '{"answer": "x", "evidence_ids": [null]}', '{"answer": "x", "evidence_ids": ["a", "a"]}', "[]", "null", "", "x", None]
    fine = {good % "": False, " " + good % ', "insufficient_evidence": "YES"' + "\n": True, good % ', "insufficient_evidence": 1': True, good % ', "insufficient_evidence": 0.0': False, good % ', "insufficient_evidence": "off"': False, good % ', "insufficient_evidence": true': True}
    rows = spark.createDataFrame([(t,) for t in [*bad, *fine]], "t string").select("t", answers.parse_answer(F.col("t")).alias("a")).collect()
    for r in rows:
        assert (r.a is None) == (r.t not in fine), r.t
        assert r.a is None or (r.a.insufficient_evidence == fine[r.t] and r.a.evidence_ids == ["E1"])


def test_generator_is_asked_again_only_where_needed(spark, tmp_path):
    asked = tmp_path / "asked"

    def client():
        def ask(system, user):
            with asked.open("a") as out:
                out.write(user.split()[0] + "\n")
            fine = user.startswith("one") or "not valid" in user
            return '{"answer": "words", "evidence_ids": ["E1"]}' if fine and not user.startswith("three") else "rubbish"

        return ask

    rows = spark.createDataFrame([(1, "s", "one", "en"), (2, "s", "two", "en"), (3, "s", "three", "en")], "query_id int, system string, user string, language string")
    rows = rows.withColumn("evidence", F.array(F.struct(F.lit("E1").alias("evidence_id"), F.lit("t").alias("quoted_text"))))
    found = {r.query_id: r.attempts for r in answers.generate(rows, client, 3).collect()}
    assert [len(found[i]) for i in (1, 2, 3)] == [1, 2, 3] and found[2][0] == "rubbish" and "words" in found[2][1]
    assert sorted(asked.read_text().split()) == ["one"] + ["three"] * 3 + ["two"] * 2


def test_http_client():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            reply = json.dumps({"response": " text "} if len(seen) == 1 else {"other": 1}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = answers.http_client(f"http://127.0.0.1:{server.server_port}/", "m", temperature=0.2)()
    assert ask("sys", "user") == "text"
    assert seen[0][0] == "/api/generate" and seen[0][1] == {"model": "m", "prompt": "user", "system": "sys", "stream": False, "options": {"temperature": 0.2}, "format": answers.ANSWER_JSON_SCHEMA}
    with pytest.raises(ValueError):
        ask("sys", "user")
    server.shutdown()


def test_chunks_count_tokens_of_the_normalised_text(spark):
    config = chunking.ChunkingConfig(30, 5, 36)
    # signs that normalise to nothing are no words
    source = " ".join(["ab", "\u200f\u200f", "cd"] * 40)
    found = list(chunking.Walk(*chunking.word_counter(), config).spans(source, 0, len(source), []))
    for a, b, form, tokens in found:
        assert form == text.normalized(source[a:b]) and tokens == len(form.split()) + 3 <= 36
    assert max(len(source[a:b].split()) for a, b, *_ in found) > 33 and found[0][0] == 0 and found[-1][1] == len(source)
    turned = list(chunking.Walk(*chunking.word_counter(), config, True).spans("رقم ١٢٣", 0, 7, []))
    assert turned[0][2].endswith("٣٢١")
    with pytest.raises(ValueError, match="one character"):
        list(chunking.Walk(lambda t: 99, lambda t: 99, config).spans("abc", 0, 3, []))


def test_chunk_files(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    row = {f.name: "x" if f.dataType.simpleString() == "string" else [] if "array" in f.dataType.simpleString() else 1 for f in spark.createDataFrame([], documents.CHUNK_SCHEMA).schema}
    import json

    (folder / "a.chunks.jsonl").write_text(json.dumps(row | {"section_type": "article"}) + "\n")
    assert documents.read_chunks(spark, str(folder)).count() == 1
    (folder / "b.chunks.jsonl").write_text(json.dumps(row | {"section_type": "verse"}) + "\n")
    with pytest.raises(Exception, match="unknown section type"):
        documents.read_chunks(spark, str(folder)).select("chunk_id").collect()


def test_vector_table_and_stream(spark, tmp_path):
    from citeloom.streaming.incremental import stream_chunks, upsert_stream

    table = index.VectorTable(spark, str(tmp_path / "t"), 4)
    rows = lambda pairs: spark.createDataFrame(pairs, "chunk_id string, v int").withColumn("vector", F.array_repeat(F.lit(0.5), 4))
    assert table.version() == 0
    table.upsert(rows([("a", 1), ("b", 1)]))
    table.upsert(rows([("b", 2), ("b", 3), ("c", 2)]), order=F.col("v"))
    assert sorted((r.chunk_id, r.v) for r in table.read().collect()) == [("a", 1), ("b", 3), ("c", 2)]
    at = table.version()
    assert table.upsert(rows([])) == at
    table.upsert(rows([("d", 1), ("d", 2), ("a", 5)]).coalesce(1))
    assert sorted((r.chunk_id, r.v) for r in table.read().collect()) == [("a", 5), ("b", 3), ("c", 2), ("d", 2)]
    before, after = (set(table.log.load(n)["folders"].items()) for n in (at, at + 1))
    assert len(after - before) <= 2 and table.vacuum(1) >= 1 and table.read().count() == 4
    with pytest.raises(ValueError, match="dimension 4"):
        index.VectorTable(spark, str(tmp_path / "t"), 8).create()
    with pytest.raises(Exception, match="dimension"):
        table.upsert(spark.createDataFrame([("z", 1)], "chunk_id string, v int").withColumn("vector", F.array(F.lit(1.0))))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.chunks.jsonl").write_text('{"chunk_id": "k1", "normalized_text": "one two"}\n')
    streamed = index.VectorTable(spark, str(tmp_path / "s"), 64)
    for _ in range(2):
        upsert_stream(stream_chunks(spark, str(folder)), streamed, lambda b: b.withColumn("vector", index.hash_embedding(F.col("normalized_text"))), str(tmp_path / "cp")).awaitTermination(60)
    assert streamed.version() == 1 and streamed.read().count() == 1


def test_gate_and_answers(spark):
    questions = spark.createDataFrame([(1, "article 7", "en"), (2, "none", "ar"), (3, "what", "en")], "query_id int, query string, language string")
    hits = spark.createDataFrame([(1, "c1", "d", 0.78, 1, "law 7 says. More"), (3, "c2", "d", 0.9, 1, "It is 5 years.")], "query_id int, chunk_id string, document_id string, score double, dense_rank_no int, text string")
    hits = hits.withColumn("section_title", F.lit(None).cast("string")).withColumn("source_file", F.lit(None).cast("string"))
    ranked = retrieval.rerank(hits.withColumn("query", F.lit("q")), F.lit(0.5))
    judged = gate.assess(questions, hits, ranked)
    assert {r.query_id: r.reason for r in judged.collect()} == {1: "exact_identifier_override", 2: "no_retrieved_evidence", 3: "sufficient"}
    evidence = answers.bounded_evidence(retrieval.select_evidence(hits, ranked))
    prompted = answers.prompts(questions, evidence)
    single = {r.query_id: r for r in answers.grounded_prompt(prompted).collect()}
    assert single[3].prompt.startswith(answers.SYSTEM["en"] + "\n\n") and [tuple(c) for c in single[3].citations] == [("[1]", "E1")] and single[2].citations == []
    raw = F.when(F.col("query_id") == 3, '{"answer":"It takes 6 years.","evidence_ids":["E1"],"insufficient_evidence":false}').otherwise('{"answer":"As the law 7 says","evidence_ids":["E1"],"insufficient_evidence":false}')
    final = answers.assemble(judged, prompted.withColumn("attempts", F.array(F.lit("broken"), raw)))
    found = {r.query_id: r for r in final.collect()}
    assert found[1].answer == "As the law 7 says [1]" and found[1].citations[0].evidence_id == "E1"
    assert found[2].reason == "no_retrieved_evidence" and not found[2].answered and found[2].answer == answers.MESSAGES["no_evidence"]["ar"]
    assert found[3].reason == "numeric_validation_failure" and "6" in found[3].answer and found[3].used_evidence == 0


def test_settings(tmp_path):
    file = tmp_path / ".env"
    file.write_text("CITELOOM_RETRIEVE_TOP_K=30\n# note\nCITELOOM_TEMPERATURE='0.5'\n")
    held = load_settings({"CITELOOM_RERANK_TOP_N": "8", "CITELOOM_GENERATOR_URL": "http://h:1/"}, str(file))
    assert (held.retrieve_top_k, held.rerank_top_n, held.temperature, held.generator_url) == (30, 8, 0.5, "http://h:1")
    for bad in ({"generator_url": "ftp://x"}, {"rerank_top_n": 21}, {"evidence_top_n": 7}, {"temperature": 3.0}, {"identifier_override_score": 0.9}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert retrieval.metadata_filter({"source": ""}) is not None
    with pytest.raises(ValueError):
        retrieval.metadata_filter({"colour": "x"})


def test_console(spark, tmp_path, monkeypatch, capsys):
    from citeloom import cli

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Article 7 Terms\nThe term of notice is two months for every lease.")
    (folder / "b.txt").write_bytes(b"\xff\xfe")
    monkeypatch.setenv("CITELOOM_INDEX_PATH", str(tmp_path / "index"))
    monkeypatch.setenv("CITELOOM_GENERATOR_URL", "http://127.0.0.1:9")
    out = str(tmp_path / "out")
    assert cli.main(["ingest", str(folder), "--output", out]) == 1
    said = capsys.readouterr().out
    assert "processed" in said and "text is not UTF-8" in said and "1 failed" in said
    assert cli.main(["ingest", str(folder / "a.txt"), "--output", out]) == 0 and "duplicate" in capsys.readouterr().out
    assert cli.main(["ingest", str(folder / "a.txt"), "--output", out, "--source", "other"]) == 1 and "other metadata" in capsys.readouterr().out
    assert cli.main(["ingest", str(folder), "--output", out, "--pages", "0"]) == 2
    assert cli.main(["ask", "Article 7 Terms The term of notice is two months for every lease.", "--language", "en"]) == 0
    said = capsys.readouterr().out
    assert "[1]" in said and "Article 7" in said
    assert cli.main(["health"]) == 1 and "failed generator" in capsys.readouterr().out
    monkeypatch.setenv("CITELOOM_GENERATOR_URL", "ftp://x")
    assert cli.main(["health"]) == 2 and "configuration error" in capsys.readouterr().out


def test_ingestion_finishes(spark, tmp_path):
    from citeloom.plans import ingestion

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_text("Article 1 Scope\nplain words here\n" + "more words of the law. " * 300)
    (folder / "same.txt").write_text((folder / "a.txt").read_text())
    (folder / "b.docx").write_bytes(docx(["First", ("x", "y"), "Last"]))
    (folder / "empty.docx").write_bytes(docx([]))
    (folder / "c.pdf").write_bytes(make_pdf([["Article 2 Terms of the pages that hold enough letters to be read", "and a second line"], [], ["third page with enough letters in it to be taken as it is, surely"]]))
    (folder / "d.pdf").write_bytes(b"%PDF-1.4\n")
    wide = ingestion.Ingestion(expected_language="en", reader=read_pages)
    run = lambda asked=wide: {r.path.rsplit("/", 1)[1]: r for r in ingestion.ingest(spark, str(folder), out, asked).collect()}
    first = run()
    assert {k: r.status for k, r in first.items()} == {"a.txt": "processed", "same.txt": "processed", "b.docx": "processed", "empty.docx": "failed", "c.pdf": "processed", "d.pdf": "failed"}
    assert (first["c.pdf"].processed_records, first["c.pdf"].direct_records, first["c.pdf"].ocr_records, first["c.pdf"].failed_records, first["c.pdf"].chunks) == (3, 2, 0, 1, 2)
    assert first["d.pdf"].error == "PDF holds nothing" and "no text" in first["empty.docx"].error and first["a.txt"].chunks > 2
    chunks = ingestion.stored_chunks(spark, out).collect()
    assert len(chunks) == sum(first[k].chunks for k in ("a.txt", "b.docx", "c.pdf"))
    by = {}
    for c in chunks:
        by.setdefault(c.document_id, []).append(c)
    assert all(sorted(c.chunk_index for c in held) == list(range(len(held))) for held in by.values())
    paged = [c for c in chunks if c.source_format == "pdf"]
    assert {(c.page_start, c.section_type, c.section_title) for c in paged} == {(1, "article", "Article 2"), (3, "article", "Article 2")}
    assert documents.read_chunks  # the contract's fields are all there
    missing = [f.name for f in spark.createDataFrame([], documents.CHUNK_SCHEMA).schema if all(c[f.name] is None for c in chunks)]
    assert missing == []
    again = run()
    assert ingestion.with_page_names(spark.createDataFrame([(1, 2, 3, 4)], "processed_records int, direct_records int, ocr_records int, failed_records int")).first()["native_pages"] == 2
    assert {r.status for k, r in again.items() if k not in ("empty.docx", "d.pdf")} == {"duplicate"} and again["c.pdf"].chunks == 2 and again["c.pdf"].failed_records == 1
    assert len(ingestion.stored_chunks(spark, out).collect()) == len(chunks)
    assert run(ingestion.Ingestion(expected_language="en", reader=read_pages, source="other"))["a.txt"].status == "failed"
    # a lost artifact is made anew
    at = ingestion.read_reports(spark, out).where(F.col("artifact") == first["c.pdf"].artifact).first().generation
    file = next(p for p in (tmp_path / "out" / "chunks" / "data" / f"g={at}").glob("*.jsonl") if first["c.pdf"].artifact in p.read_text())
    broken = {k for k in ("a.txt", "b.docx", "c.pdf") if first[k].artifact in file.read_text()}
    file.unlink()
    third = run()
    assert {k for k in ("a.txt", "b.docx", "c.pdf") if third[k].status == "processed"} == broken and "c.pdf" in broken
    assert len(ingestion.stored_chunks(spark, out).collect()) == len(chunks)
    narrow = ingestion.Ingestion(expected_language="en", reader=read_pages, limits=chunking.ChunkingConfig(100, 10, 120))
    assert run(narrow)["a.txt"].chunks > first["a.txt"].chunks
    with pytest.raises(ValueError, match="PDF files only"):
        ingestion.ingest(spark, str(folder / "a.txt"), out, ingestion.Ingestion(page_limit=1))
    limited = ingestion.ingest(spark, str(folder / "c.pdf"), out, ingestion.Ingestion(page_limit=1, reader=read_pages)).first()
    assert limited.artifact.endswith("-first-1") and limited.processed_records == 1
    for bad in ({"page_limit": 0}, {"document_version": 0}, {"source": " "}, {"expected_language": "fr"}):
        with pytest.raises(ValueError):
            ingestion.Ingestion(**bad)


def test_questions_in_blocks(spark, monkeypatch):
    rows = spark.range(30).select(F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.3)).alias("vector"))
    asked = spark.range(9).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id"), F.lit(0.1)).alias("query_vector"))
    whole = sorted(map(tuple, retrieval.dense_topk(asked, rows, k=3).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_QUESTIONS", 4)
    assert sorted(map(tuple, retrieval.dense_topk(asked, rows, k=3).collect())) == whole and len(whole) == 27
