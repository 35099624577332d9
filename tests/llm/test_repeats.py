"""Removal of repeated byte strings against trying every string; transforms and their merge by themselves."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from citeloom.llm import repeats


def brute(rows, width):
    raws = [(t or "").encode() for _, t in rows]
    often = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if often[raw[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), int(np.diff(np.concatenate(([0], gone.view(np.int8)))).clip(0).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def planted(seed, n=60):
    """Texts of few letters that share passages, are near copies, hold runs of one letter and their own beginnings again."""
    rng = random.Random(seed)
    some = lambda k, letters="ab ": "".join(rng.choice(letters) for _ in range(k))
    passages = [some(rng.randrange(15, 60)) for _ in range(6)]
    out = []
    for i in range(n):
        text = some(rng.randrange(0, 50)) + rng.choice(passages) + some(rng.randrange(0, 9)) + rng.choice(passages)[: rng.randrange(60)] + some(rng.randrange(0, 30), "abcdefgéß日\0")
        if i % 7 == 0:
            text += "x" * rng.randrange(10, 70)
        if i % 9 == 0:
            text += text[:40]
        out.append((i, text))
    out += [(100, out[3][1]), (101, out[3][1]), (102, out[4][1][:-1] + "Q"), (103, None), (104, ""), (None, out[5][1][5:]), (None, "x")]
    return out


def found(spark, rows, **options):
    held = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], "doc_id long, text string, key string, copies int, tid int")
    return sorted(str(tuple(r)) for r in repeats.remove_repeats(held, **options).collect())


@pytest.mark.parametrize(("width", "gram", "most", "shard", "merged"), [(20, 8, 10**6, 32_768, 32_768), (20, 16, 10**6, 7, 5), (24, 1, 3, 11, 1), (16, 16, 2, 50, 20)])
def test_matches_trying_every_string(spark, monkeypatch, width, gram, most, shard, merged):
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "MERGED", merged)
    rows = planted(width * gram)
    assert found(spark, rows, width=width, gram=gram, most=most) == brute(rows, width)


def test_documents_at_full_width(spark, docs, empty, pairs):
    assert sorted(str(tuple(r)) for r in repeats.remove_repeats(docs).collect()) == brute(pairs, 200)
    assert repeats.remove_repeats(empty).count() == 0
    kept = repeats.remove_repeats(docs, with_text=True)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept.collect())


def test_arguments():
    for width, gram in ((200, 60), (10, 16), (400, 64)):
        with pytest.raises(ValueError, match="gram"):
            repeats.remove_repeats(None, width=width, gram=gram)


@pytest.mark.parametrize("seed", range(8))
def test_merge_of_transforms_finds_equal_windows(seed):
    """Shards of rows of two anchors; windows of 6 of 10 columns; against comparing all windows."""
    rng = np.random.default_rng(seed)
    n, width, columns = 40, 6, 10
    rows = rng.integers(0, 2 + seed % 3, (n, columns)).astype(np.uint8)
    anchor = np.sort(rng.integers(0, 3, n))
    shard = np.sort(rng.integers(0, 4, n))
    order = np.lexsort((shard, anchor))
    anchor, shard, rows = anchor[order], shard[order], rows[order]
    low = rng.integers(0, 3, n)
    high = np.minimum(4, low + rng.integers(0, 4, n))
    anchor_first = np.append(True, anchor[1:] != anchor[:-1])
    shard_first = anchor_first | np.append(True, shard[1:] != shard[:-1])
    marks = repeats.repeated_windows(repeats.transform(rows, shard_first), shard_first, anchor_first, low, high, width)
    for c in range(columns - width + 1):
        windows = [(anchor[i], rows[i, c : c + width].tobytes()) if low[i] <= c <= high[i] else None for i in range(n)]
        often = Counter(w for w in windows if w)
        assert marks[c].tolist() == [bool(w and often[w] > 1) for w in windows]


def test_transform_is_that_of_sorted_suffixes():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 3, (30, 8)).astype(np.uint8)
    first = np.zeros(30, bool)
    first[[0, 1, 12]] = True
    out = repeats.transform(rows, first)
    for a, b in ((0, 1), (1, 12), (12, 30)):
        for c in range(8):
            order = sorted(range(a, b), key=lambda i: rows[i, c + 1 :].tobytes())
            assert out[c, a:b].tolist() == [rows[i, c] for i in order]


@pytest.mark.parametrize("piece", [7, 64, 1 << 18])
def test_anchors_are_those_of_each_window(piece):
    rng = random.Random(piece)
    texts = ["".join(rng.choice("ab") for _ in range(k)).encode() for k in (0, 5, 19, 20, 90, 21, 300)] + [b"a" * 50]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    seen = set()
    for text, place, _, low, high in zip(*repeats.anchors(data, ends, 20, 8, piece)):
        for c in range(low, high + 1):
            start = place - 12 + c
            assert 0 <= start <= len(texts[text]) - 20 and start <= place <= start + 12
            assert (text, start) not in seen
            seen.add((text, start))
    assert seen == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 19)}


def test_sql_gives_the_same(spark, small):
    import duckdb

    from citeloom.llm.registry import op11_suffix_array_dedup

    held = duckdb.connect()
    held.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    wanted = held.execute(repeats.REPEATS_SQL).fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in op11_suffix_array_dedup(spark, small).collect())
