"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on hostile small tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import decontaminate, embeddings, jaccard, language, packing, quality, secrets, sharding, substrings, wavelet
from daybook.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, key string, words string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (3, 60, 90, 140, 700)]
    near = base[3].split()
    near[70] = "Changed"
    out = [*base, base[1], base[1], " ".join(near), base[2] + " " + base[3][100:420] + " tail", None, "", " \n\t ", "é" * 500, "x" * 900, "word", "A b C d E f g", "a b c d e f g"]
    return list(enumerate(out)) + [(1, base[1]), (None, base[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, 0.5, "k", "w") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


def test_repeats_match_brute_force(docs, none, texts):
    n, raws = 200, [(t or "").encode() for _, t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    want = []
    for (i, _), r in zip(texts, raws, strict=True):
        gone = bytearray(len(r))
        for k in range(len(r) - n + 1):
            if seen[r[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, y in zip(r, gone, strict=True) if not y)
        want.append((i, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sorted(rows(substrings.remove_repeats(docs)), key=key) == sorted(want, key=key)
    assert rows(substrings.remove_repeats(none)) == []


def test_jaccard_components_match_brute_force(docs, none, texts):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and 100 * len(a & b) >= 75 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    ids = [i for i, _ in texts]
    want = []
    for k, i in enumerate(ids):
        group = [ids[j] for j in range(len(ids)) if part[j] == part[k] and ids[j] is not None]
        want.append((i, len(sets[k]), min(group) if sets[k] and group else i))
    assert sorted(rows(jaccard.join(docs)), key=key) == sorted(want, key=key)
    assert rows(jaccard.join(none)) == []


def test_language_is_told_apart_and_nothing_is_undetermined(spark, docs, none):
    rng = random.Random(1)
    speech = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 11))) for _ in range(150)] for x in ("abcde", "vwxyz")}
    say = lambda x: " ".join(rng.choice(speech[x]) for _ in range(60))
    train = spark.createDataFrame([(say("abcde"), "one") for _ in range(30)] + [(say("vwxyz"), "two") for _ in range(30)] + [(None, "one"), ("x", None)], "text string, lang string")
    learned = language.learn_dictionaries(train)
    test = spark.createDataFrame([(i, say("abcde" if i % 2 else "vwxyz"), "?") for i in range(40)] + [(50, None, ""), (51, "12 34 !", ""), (52, "", "")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.identify(test, learned).collect()}
    assert all(got[i].lang_pred == ("one" if i % 2 else "two") and 0 <= got[i].score <= 1 for i in range(40))
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (50, 51, 52))
    assert language.identify(docs, {}).where("lang_pred != 'und'").count() == 0
    assert rows(language.identify(none, learned)) == []


def test_secrets_in_layers():
    plain = "see token=abcdefgh now"
    assert secrets.find(plain) == ([(4, 0, 18)], [(4, 0, 18)])
    assert secrets.find("password: token: abcdefgh")[0] == [] and secrets.find(None) == ([], [])
    inner = "secret = abcdefghij"
    b64 = base64.b64encode(inner.encode()).decode()
    for wrapped in (b64, base64.b64encode(gzip.compress(inner.encode())).decode(), base64.b64encode(b64.encode()).decode(), quote(inner, safe=""), "".join(f"\\u{ord(c):04x}" for c in inner), quote(quote(b64, safe=""), safe="")):
        base, spans = secrets.find(f"q {wrapped} z")
        assert base == [] and any(k == 0 and a >= 2 and b <= 2 + len(wrapped) for a, k, b in spans), wrapped
        assert secrets.mask(f"q {wrapped} z").startswith("q [secret]") or "%" in wrapped or "\\" in wrapped
    bomb = base64.b64encode(b"%41" * 50).decode()
    assert secrets.find(bomb * 3)[0] == []


def test_secret_report_on_hostile_rows(docs, none, texts):
    got = rows(secrets.report(docs))
    assert len(got) == len(texts) and rows(secrets.report(none)) == []


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    v = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), base[:5], base[:1] + 0.05 * rng.standard_normal((700, 16))])
    data = [(i, [float(x) for x in r], i % 2 if i < 80 else 0) for i, r in enumerate(v)]
    odd = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [None] + [1.0] * 15, 0), (9004, [float("nan")] * 16, 0), (9005, [1.0] * 16, None), (9006, [], 1), (9007, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in data + odd], "vec_id long, embedding array<double>, label int, cid string")
    got = {r.vec_id: r for r in embeddings.join(df).collect()}
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in data])[:, None] == np.array([r[2] for r in data]))
    links = np.array([got[i].n_links for i in range(len(v))])
    assert (links <= near.sum(axis=1) - 1).all() and links.sum() >= 0.99 * (near.sum() - len(v))
    assert all(got[r[0]].n_links == 0 and got[r[0]].component_id == r[0] and got[r[0]].kept for r in odd)
    assert rows(embeddings.join(df.limit(0))) == []


def test_quality_learns_from_positives(spark, none):
    rng = random.Random(3)
    good = [prose(rng, 80) for _ in range(150)]
    bad = [" | ".join(prose(rng, 1) for _ in range(80)) for _ in range(100)]
    train = [(t, 1) for t in good[:80]] + [(t, None) for t in good[80:120]] + [(t, 0 if i % 3 else None) for i, t in enumerate(bad[:70])] + [(None, None), (None, 1)]
    own = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train)] + [(None, good[0]), (3, bad[3])], "doc_id long, text string")
    judged = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(train)] + [(3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    model = quality.learn(own, judged)
    assert 0.4 < model["prior"] < 0.8  # 121 of 194 rows
    test = spark.createDataFrame([(t, 1) for t in good[120:]] + [(t, 0) for t in bad[70:]] + [(None, None), ("", None)], "text string, score int")
    got = rows(quality.scored(test, model).select("text", "score", "predicted"))
    assert all(0 <= s <= 1 for _, s, _ in got) and [p for *_, p in got[:60]] == [1] * 30 + [0] * 30
    assert quality.learn(own, judged.where("quality = 0")) is None and quality.learn(own.limit(0), judged) is None
    assert rows(quality.scored(none, model)) == []


def test_quality_sample_of_copies_keeps_its_bound(spark):
    """Copies of one positive come as one text with a weight, and never crowd out a model."""
    known = spark.range(40_000).select((F.col("id") * 0 + 7).alias("h"), F.lit(True).alias("good")).unionByName(
        spark.range(500).select((F.col("id") + 1000).alias("h"), F.lit(False).alias("good")))
    drawn = {r.h: (r.p, r.u) for r in quality.draw(known, 80, 160).collect()}
    assert drawn[7][0] == 40_000 and drawn[7][1] in (0, 40_000)
    assert sum(1 for p, _ in drawn.values() if p) == 1 and sum(1 for _, u in drawn.values() if u) == 160


def test_token_files_round_trip(spark, docs, none, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    odd = ["a  b", " lead", "trail ", "x\n\ny z", "tab\tin it", "don't 123 45 <|endoftext|> ok", "line\nnext word\nlast", "   "]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for frame, source in ((df, list(enumerate(odd))), (docs, texts)):
        ids = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        got = rows(wavelet.token_files(frame, tokenizer_path()))
        assert sorted((zlib.crc32(ids(x)), len(ids(x))) for _, x in source) == sorted((g[3], g[2]) for g in got)
        at = 0
        for g in sorted(got, key=lambda g: g[1]):
            assert g[1] == at
            at += g[2]
        assert [g[0] for g in sorted(got, key=lambda g: g[1])] == sorted((i for i, _ in source), key=lambda i: (i is not None, i))
    assert rows(wavelet.token_files(none, tokenizer_path())) == []


def test_wavelet_access_rank_select():
    a = np.random.default_rng(0).integers(0, 700, 3000).astype("<u4")
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(a).to_bytes())
    assert (w.decode() == a).all()
    for s in (0, 5, 699, 5000):
        at = np.flatnonzero(a == s)
        assert w.count(s) == len(at) and w.rank(s, 1111) == (at < 1111).sum()
        assert [w.select(s, i) for i in range(min(5, len(at)))] == at[:5].tolist()
    assert [w.access(i) for i in (0, 511, 512, 2999)] == [int(a[i]) for i in (0, 511, 512, 2999)]
    assert wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(a[:0]).to_bytes()).decode().size == 0


def test_packing_is_gapless_and_tight(docs, none, texts):
    got = packing.pack(docs, tokenizer_path(), 64).toPandas()
    assert (got.length <= 64).all() and (got.length > 0).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 2
    assert (got.piece == 0).sum() == len(texts) and rows(packing.pack(none, tokenizer_path())) == []
    assert sum(n for n, _ in packing.plan({60: 3, 40: 3, 100: 1, 33: 3}, 100)) == 5
    assert len(packing.branch({6: 2, 5: 2, 4: 2, 3: 2, 2: 1}, 10)) == 4


def test_decontamination_matches_brute_force(spark, docs, none, texts):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    items = [(1, texts[2][1][30:200]), (2, "word"), (3, None), (4, "!!"), (5, "b c d"), (10, texts[3][1]), (10, texts[3][1]), (None, "x y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in texts:
        w, places, names = split(t), set(), set()
        for item, own in items:
            v = split(own)
            for s in range(max(1, len(v) - 9)) if v else ():
                x = v[s : s + 10]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        places.update(range(p, p + len(x)))
                        names.update([str(item)] if item is not None else [])
        want.append((i, len(w), len(places), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(places)))
    by_text = lambda r: tuple(map(str, r))
    clean = spark.createDataFrame([(1, items[0][1]), (1, "clean words only"), (None, "x y z"), (None, "clean")], "doc_id long, text string")
    for kw in ({}, {"broadcast_rows": 0}):
        seen = {(r.doc_id, r.n_words): (r.n_hit, r.contaminated) for r in decontaminate.contaminated_words(clean, bench, **kw).collect()}
        assert seen[1, 3] == (0, False) and seen[None, 1] == (0, False) and seen[None, 3] == (3, True) and sum(c for _, c in seen.values()) == 2
        got = rows(decontaminate.contaminated_words(docs, bench, **kw).drop("text_id"))
        assert sorted(map(tuple, got), key=by_text) == sorted(want, key=by_text), kw
    assert rows(decontaminate.contaminated_words(none, bench)) == []
    assert decontaminate.contaminated_words(docs, bench.limit(0)).where("contaminated").count() == 0


def test_shards_are_gapless_and_even(spark, docs, none, texts):
    many = docs.unionByName(spark.range(3000).selectExpr("id + 100 AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE repeat('z', cast(id % 50 AS int)) END AS text"), allowMissingColumns=True)
    got = sharding.shard(many).toPandas()
    assert len(got) == 3000 + len(texts) and set(got.law) == {"bytes"} and got.shard.between(0, 39).all()
    assert (got.groupby("shard").slot.nunique() == got.groupby("shard").slot.max() + 1).all()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    assert rows(sharding.shard(none)) == []
    few = sharding.shard(docs, 3).toPandas()
    assert len(few) == len(texts)
