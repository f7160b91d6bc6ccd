"""Scores of test items do not depend on the blocks that the index is cut into."""

import random

from formloom.llm import decontaminate


def test_statistics_of_all_items(spark, monkeypatch):
    random.seed(9)
    vocabulary = [f"v{k}" for k in range(60)]
    texts = [[random.choice(vocabulary[: 20 + 4 * k]) for _ in range(18 + k)] for k in range(10)]
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(90, ""), (91, None)], "item_id long, text string")
    docs = spark.createDataFrame([(10 * k + m, " ".join(["x"] * 5 + t[: len(t) - m] + ["y"] * 5)) for k, t in enumerate(texts) for m in (0, 3, 6)], "doc_id long, text string")
    found = []
    for block in (2048, 3, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        found.append(sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect())))
    assert found[0] == found[1] == found[2]
    assert any(row[2] < 0.99 for row in found[0]) and {(10 * k, k) for k in range(10)} <= {row[:2] for row in found[0]}
