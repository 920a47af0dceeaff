"""Divergences of sources against a plain version over all terms."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from daybook.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, counts string, value int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, most=200):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((x or "" for x in r) for r in rows):
        terms = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        v, total = len(kept), {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + v) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // (sum(total.values()) + v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s, t], p[o, t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s, t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s, t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item, -x, i + 1) for i, (x, _, item) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", "c", 1) for i, r in enumerate(rows)], SCHEMA)


def test_audit_matches_a_plain_version(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("Ab", "cé", "日", "x", "ÀB", "zz") for b in ("", "q", "R", "ss", "t")]
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "en", "en", "de", "", None])
        source = rng.choice(["hot", "hot", "hot", "b", "c", "", None, "é", "z"])
        rows.append((" ".join(rng.choice(words[: 8 + len(source or "") * 9]) for _ in range(rng.randint(0, 40))) + rng.choice(["", "1,2.", "_a-b'c"]), lang, source))
    rows += [(None, "en", "empty"), ("", "fr", "alone"), ("1 2 3", "it", "a"), ("rare words", "it", "b"), ("x " * 50_000, "en", "long"), *[rows[0]] * 20]
    got = [tuple(r) for r in divergence.audit(frame(spark, rows).repartition(4)).collect()]
    assert sorted(got) == expected(rows)
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, rows), most_terms=3).collect()) == expected(rows, 3)


def test_corrections_of_a_tree_shared_by_many_rows(spark):
    rows = [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)), "en", s) for s in "abcdefgh" for _ in range(3)]
    rows += [("waa wba " * n, "en", s) for n, s in enumerate("abc")]
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, rows)).collect()) == expected(rows)


def test_no_rows(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_a_node_of_many_rows_is_corrected_exactly(monkeypatch):
    monkeypatch.setattr(divergence.Tree, "WAITING", 3)
    rng = random.Random(1)
    shares = {(s, n): rng.randint(1, 10**9 + 1) for s in range(4) for n in range(4)}
    rows = sorted({tuple((s, rng.randint(1, 3)) for s in range(4) if rng.random() < 0.7): rng.choice([1, 3, 10**7]) for _ in range(60)}.items())
    tree, prefix, want = divergence.Tree(), [], Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for row, times in rows:
        if not row:
            continue
        shared = next((k for k, (a, b) in enumerate(zip(prefix, row)) if a != b), min(len(prefix), len(row)))
        tree.close(shared)
        prefix[shared:] = row[shared:]
        for s, n in row[shared:]:
            tree.insert(s, shares[s, n], shares[s, 0])
        tree.times[tree.path[-1]] += times
        for a, n in row:
            for b, m in row:
                if a != b:
                    p, p0, q, q0 = shares[a, n], shares[a, 0], shares[b, m], shares[b, 0]
                    want[a, b] += times * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
    tree.close(0)
    tree.correct()
    assert tree.sums == dict(want)
