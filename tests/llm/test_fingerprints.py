"""Order MinHash against a plain version that hashes as Spark does."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import regex
import xxhash

from daybook.llm import order_minhash as M

TOKEN = regex.compile(
    r"(?V1)[[\p{L}\p{M}]--[\u0E00-\u0E7F\u1100-\u11FF\u2E80-\uD7FF\uF900-\uFAFF\U00020000-\U0003FFFF]]{1,24}|[0-9]{1,24}|[^ ]", regex.DOTALL)
SCHEMA = "doc_id long, text string, head string, copies string, edited string, times int"


def folded(*parts: bytes) -> int:
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p, seed=seed).intdigest()
    return seed


def plain(text):
    tokens = [t.encode() for t in TOKEN.findall(text or "")]
    if not tokens:
        return ""
    high = (1 << 63) - (1 << 27)
    keys = [folded(*tokens[i : i + 3]) & high for i in range(len(tokens))]
    seen, ring = Counter(), []
    for place, k in enumerate(keys):
        again = folded(k.to_bytes(8, "little"), seen[k].to_bytes(4, "little")) & high
        ring.append((again if seen[k] else k, place))
        seen[k] += 1
    ring.sort()
    out = []
    for j in range(64):
        start = next((i for i, (h, _) in enumerate(ring) if h >= j << 57), 0)
        places = sorted(ring[(start + t) % len(ring)][1] for t in range(min(2, len(ring))))
        out.append(f"{folded(*[keys[p].to_bytes(8, 'little') for p in places]) & 0xFFFF:04X}")
    return "".join(out)


def alike(a, b):
    if a == b:
        return 1.0
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)) / 64 if a and b else 0.0


def expected(rows):
    texts = [(i, t or "") for i, t in rows]
    texts.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'null' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()))
    out = []
    for n, (i, t) in enumerate(texts):
        follow = texts[(n + 1) % len(texts)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + follow[:cut]
        f, g = plain(t), plain(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, alike(f, g), alike(f, plain(follow))))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 9, 40, 200, 900)]
    texts += [None, "", "   ", "a " * 700, "x" * 900, "日本語のテキスト、漢字。" * 9, "né à 12345 l'été\n\n😀😀 ok", "a b c d e f g", texts[4], texts[5] + " and more"]
    return [*enumerate(texts), (5, texts[5]), (5, texts[5]), (5, "another row"), (None, "no id"), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "c", "e", 1) for i, t in rows], SCHEMA)


def test_fingerprints_match_a_plain_version(spark, rows):
    got = [tuple(r) for r in M.edited_fingerprints(frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_one_row_and_no_rows(spark):
    assert M.edited_fingerprints(frame(spark, [])).collect() == []
    one = [(4, "only one document, its own next")]
    assert [tuple(r) for r in M.edited_fingerprints(frame(spark, one)).collect()] == expected(one)


def test_likeness_falls_with_edits_and_with_order(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
    swapped = words[300:] + words[:300]
    few, many = list(words), list(words)
    for w, n in ((few, 6), (many, 120)):
        for i in rng.sample(range(600), n):
            w[i] = "changed"
    df = spark.createDataFrame([(" ".join(words), " ".join(x), n) for n, x in (("few", few), ("many", many), ("swapped", swapped))], "a string, b string, name string")
    df = M.with_fingerprint(M.with_fingerprint(df, "a", "fa"), "b", "fb")
    near = {r.name: r.near for r in df.select("name", M.likeness("fa", "fb").alias("near")).collect()}
    assert near["few"] > 0.8 and near["many"] < near["few"] - 0.3 and near["swapped"] < near["few"] - 0.2
