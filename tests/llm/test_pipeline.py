"""The pipeline on small tables: stages keep the columns, decisions take effect, the packing holds what the mix took."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from citeloom.llm import registry

pytest.importorskip("public_tokenizers")


def test_stages_and_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= seen and ids
        assert name == "mixing" or len(ids) == len(set(ids))
        assert max(Counter(ids).values()) <= 2
        seen = set(ids)
    packed = corpus_pipeline.run(spark, small)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_decide_as_plain_python_does(spark, tmp_path):
    """Planted rows through every stage, against what plain Python says of them."""
    import random

    from tests.llm.conftest import words
    from tests.llm.test_operators import plain_components, plain_fingerprint

    rng = random.Random(7)
    rows, labels = [], []
    for i in range(360):
        bad, rude = i % 6 == 0, i % 9 == 1
        text = words(i, 60) + (" scoundrel blockhead numbskull " if rude else " ") + words(5000 + i, 60)
        rows.append([i, "| sep ### | " * 40 if bad else text, "en", f"s{i % 3}", 0])
        labels.append((i, int(not bad), int(rude)))
    for i in range(40):  # copies of clean rows
        rows.append([1000 + i, rows[2 + 6 * i][1] if 2 + 6 * i < 360 else words(i, 90), "en", "s0", 0])
    rows += [[2000, None, None, None, None], [2001, "", "de", "s1", 0], [None, words(77, 120), "en", "s2", 5], [None, None, None, None, None], [2002, words(78, 100), "en", "s1", 1], [2002, words(79, 100), "en", "s1", 1]]
    made = [(r[0], r[1], r[2], r[3], None if r[4] is None else len(r[1] or ""), 0.5, "x", "h") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, own string, _row string"
    docs = spark.createDataFrame(made, schema)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    held, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, folder).cache()
        assert held.columns == docs.columns, name
        seen[name] = [tuple(r) for r in held.collect()]
    known = {i: (q, t) for i, q, t in labels}
    kept = {r[0] for r in seen["quality"]}
    assert sum(known[i][0] != (i in kept) for i in known) <= 8
    kept_after = {r[0] for r in seen["toxicity"]}
    assert sum((not known[i][1]) != (i in kept_after) for i in known if i in kept) <= 8
    prints = [plain_fingerprint(r[1]) for r in seen["toxicity"]]
    groups = plain_components(prints, 4)
    best = {}
    for g, r in zip(groups, seen["toxicity"]):
        rank = (r[0] is None, r[0] or 0, r[1] is None)
        best[g] = min(best.get(g, (rank, r)), (rank, r), key=lambda x: x[0])
    assert Counter(r for r in seen["near_dedup"]) == Counter(r for _, r in best.values())
    assert set(seen["mixing"]) <= set(seen["near_dedup"]) and max(Counter(seen["mixing"]).values()) <= 2
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(str(r.doc_id) for r in packed if r.piece == 0) == Counter(str(r[0]) for r in seen["mixing"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, small, name):
    from pathlib import Path

    held = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        held.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found, wanted = registry.queries()[name](spark, small), held.execute(registry.oracle_sql()[name])
    columns, names = sorted(found.columns), [c[0] for c in wanted.description]
    assert columns == sorted(names)
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in wanted.fetchall())
