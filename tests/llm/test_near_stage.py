"""The pipeline's near-dedup stage between its own threshold and that of the query op6."""

import random

import brute
import corpus_pipeline as cp


def test_stage_takes_copies_from_four_fifths_on(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for family in range(6):
        base = [f"w{family}x{k}" for k in range(150)]
        for edits in (0, 2, 3, 4, 5):
            words = list(base)
            for k in rng.sample(range(0, 150, 6), edits):
                words[k] = f"v{i}x{k}"
            rows.append((i * 7 % 1009, " ".join(words)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d for d, (_, c) in brute.components(rows, 80).items() if c == d}
    assert want < {d for d, (_, c) in brute.components(rows, 85).items() if c == d}
    assert {r["doc_id"] for r in dict(cp.STAGES)["minhash_near_dedup"](spark, docs, "").collect()} == want
