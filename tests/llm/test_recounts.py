"""Scores of the classifiers counted again in plain Python, from the models that they learned."""

from __future__ import annotations

import math
import random

import numpy as np

from tests.llm.conftest import words


def sample(spark, label):
    rude, rng = ("scoundrel", "blockhead", "numbskull", "dunderhead"), random.Random(2)
    rows = [(i, f"{words(i, 40)} {rng.choice(rude) + '!' if i % 4 == 0 else ''} {words(900 + i, rng.randint(5, 60))}", int(i % 4 == 0), 7 * i) for i in range(240)]
    rows += [(240, None, 0, None), (241, "", 0, 0), (242, " \n!? ", 1, 3)]
    return rows, spark.createDataFrame(rows, f"doc_id long, text string, {label} int, n_chars long")


def test_toxicity_scores_and_calibration_are_those_of_a_plain_count(spark):
    from citeloom.llm import toxicity as X
    from citeloom.llm.labelled import with_scores

    rows, made = sample(spark, "toxic")
    docs, labels = made.select("doc_id", "text"), made.select("doc_id", "toxic")
    model = X.train(docs, labels)

    def gap(window):
        block = (b" " + window) * X.REPEATS + b" "
        return len(X.Gap._compressor(model.ordinary)(block)) - len(X.Gap._compressor(model.ordinary + model.toxic)(block))

    known = {}
    def weights(text, threshold):
        found = 0
        for w in X.windows(text, model.width):
            if w not in known:
                known[w] = gap(w)
            found += model.listed.get(w, 1) if known[w] >= max(1, threshold) else 0
        return min(X.TOP_COUNT, found)

    scored = {r.doc_id: r.score for r in with_scores(docs, X.scorer(spark.sparkContext.broadcast(model))).collect()}
    for doc, text, *_ in rows:
        assert scored[doc] == model.probability[weights(text, model.threshold)], doc
    # the threshold and the probabilities, from the rows that may be learned from
    import zlib

    learned = [(t, y) for d, t, y, _ in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    n = [sum(y == k for _, y in learned) for k in (0, 1)]
    share = [k / sum(n) for k in n]
    best = None
    for threshold in range(1, 13):
        mass = np.zeros((2, X.TOP_COUNT + 1))
        for t, y in learned:
            mass[y, weights(t, threshold)] += share[y] / n[y]
        p, top = [], 0.0
        for c in range(X.TOP_COUNT + 1):
            seen = mass[:, c].sum() > 0
            top = max(top, (mass[1, c] * sum(n) + share[1]) / (mass[:, c].sum() * sum(n) + 1) if seen else 0)
            p.append(top)
        loss = -sum(mass[1, c] * math.log(min(max(p[c], 1e-6), 1 - 1e-6)) + mass[0, c] * math.log(1 - min(max(p[c], 1e-6), 1 - 1e-6)) for c in range(X.TOP_COUNT + 1))
        if best is None or loss < best[0] - 1e-12:
            best = (loss, threshold, p)
    assert model.threshold == best[1] and np.allclose(model.probability, best[2])


def test_quality_scores_are_those_of_all_pairs(spark):
    from citeloom.llm import quality as Q
    from citeloom.llm.labelled import with_scores

    rows, made = sample(spark, "quality")
    docs, labels = made.select("doc_id", "text", "n_chars"), made.select("doc_id", "quality")
    machine = Q.train(docs, labels)
    scored = {r.doc_id: r.score for r in with_scores(docs, Q.scorer(spark.sparkContext.broadcast(machine), ("n_chars",)), extra=["n_chars"]).collect()}
    for doc, text, _, n_chars in [*rows[:25], *rows[-3:]]:
        index, x = Q.features(text, [("n_chars", n_chars)])
        margin = machine.bias + sum(machine.w[i] * v for i, v in zip(index, x))
        for a in range(len(index)):
            for b in range(a):
                margin += float(machine.v[index[a]] @ machine.v[index[b]]) * x[a] * x[b]
        assert math.isclose(scored[doc], 1 / (1 + math.exp(-min(50, max(-50, margin)))), abs_tol=1e-9), doc
