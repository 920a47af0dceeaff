"""Pairs of sets that share a passage and no more are left out before their texts are compared."""

from __future__ import annotations

import random

import numpy as np

from daybook.llm import jaccard


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = random.Random(3)
    for n in (1, 4, 30, 300, 3000):
        one = words(rng, n)
        for changed in (0, 1, n // 7, n):
            two = list(one)
            for i in rng.sample(range(n), changed):
                two[i] = "changed"
            a, b = (jaccard.shingles(" ".join(x), 5) for x in (one, two))
            apart = np.bitwise_count(jaccard.sketch(a).view(np.uint64) ^ jaccard.sketch(b).view(np.uint64)).sum()
            assert len(jaccard.sketch(a)) == 8 and apart <= len(np.setxor1d(a, b))


def test_a_common_passage_makes_few_comparisons(spark, monkeypatch):
    rng = random.Random(11)
    passage = words(rng, 28)
    texts = [passage + words(rng, 20) for _ in range(40)]
    texts.append([*texts[0][:-1], "other"])
    compared, verify = [], jaccard.linked_pairs

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard, "linked_pairs", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.join(docs).collect()} == {(i, i) for i in range(40)} | {(40, 0)}
    assert sum(compared) <= 10
