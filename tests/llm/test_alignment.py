"""Cross-tokenizer alignment against whole texts, tokenised and aligned in plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from citeloom.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "plain words here", " leading", "trailing ", "two  spaces   and four    ", "line\n next\n\nline \n end\n", "tab\tand \t mix", "   ", "\n", " \n \n ", "nbsp here   there  x", "　wide　 space",
    "piece ▁ mark", "a▁b", "<|endoftext|> and <s> </s> <0x41>", "it's don't we'll 's x 'S", "emoji 👩‍👩‍👧 ok", "日本語 テスト text", "\x00nul \x1f x\x1c y", "x" * 700, "é ﬁ Å ａ", "());\r\n {\r\n }\r", "12 345,6 7", "مرحبا بالعالم ١٢",
    "  sep  x", "\u0085 nel\u0085 x", "​ zero​ x", "﻿ bom",
]


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    pair = alignment.Pair(A, B)
    found, held = [], []
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        ids_a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = pair.b.encode(text) if text else []
        parts_a, parts_b = [pair.bytes_a[i] for i in ids_a], [pair.bytes_b[i] for i in ids_b]
        if not text or b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            found.append([doc, 0, 0, 0, 0, ""])
            held.append([])
            continue
        on_a, on_b = spans(parts_a), spans(parts_b)
        ends = sorted({e for _, e in on_a} & {e for _, e in on_b})
        groups, at = [], 0
        for end in ends:
            inside = lambda s: at <= s[0] and s[1] <= end  # noqa: E731, B023
            groups.append(",".join(str(i) for i, s in zip(ids_a, on_a) if inside(s)) + "|" + ",".join(str(i) for i, s in zip(ids_b, on_b) if inside(s)))
            at = end
        links = [(i, j) for i, s in zip(ids_a, on_a) for j, t in zip(ids_b, on_b) if s[0] < t[1] and t[0] < s[1]]
        found.append([doc, len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        held.append(links)
    counts = Counter(p for links in held for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return sorted(((*f[:5], sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), f[5]) for f, links in zip(found, held)), key=str)


@pytest.mark.parametrize("size", [1 << 22, 700])
def test_alignment_matches_whole_texts(spark, docs, empty, pairs, size):
    # texts of plain words stand beside the odd ones; the quadratic check leaves out the very long one
    rows = [p for p in pairs if len(p[1] or "") < 6000] + [(100 + k, t) for k, t in enumerate(ODD)] + [(100, ODD[0])] * 3
    held = spark.createDataFrame([(d, t, "c", 1, True) for d, t in rows], "doc_id long, text string, block string, pair long, sound boolean")
    found = alignment.align_documents(held, A, B, block_bytes=size)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
    assert alignment.align_documents(empty, A, B).count() == 0


def test_counts_joined_by_a_shuffle_are_the_same(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(ODD)]
    held = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(alignment, "BROADCAST_LINKS", 0)
    assert sorted((tuple(r) for r in alignment.align_documents(held, A, B).collect()), key=str) == brute(rows)


def test_the_very_long_text(spark, docs):
    from citeloom.llm.alignment import Pair

    pair = Pair(A, B)
    row = docs.where("doc_id = 36").select("doc_id", "text")
    text = row.first().text
    found = alignment.align_documents(row, A, B).first()
    assert (found.n_a, found.n_b) == (len(pair.a.encode(" " + text).ids), len(pair.b.encode(text)))


def test_segments_are_whole_and_cut_before_spaces():
    for text in ODD:
        found = alignment.segments(text)
        assert "".join(" " + s for s in found) == " " + text
        assert all(s and not s[-1].isspace() for s in found[:-1])
    assert alignment.segments("one two  three\n four") == ["one", "two", " three\n four"]


def test_cuts_are_verified():
    assert alignment.can_cut([b" a", b"  ", b"\n ", b"\xc2\xa0 \xc2\xa0", b"a"])
    assert not alignment.can_cut([b"a b"])
    assert not alignment.can_cut([b"\xa0 "])
    assert alignment.Pair(A, B).cut
