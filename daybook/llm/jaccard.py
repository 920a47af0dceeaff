"""Exact Jaccard self-join of word-shingle sets by set relations.

*Index.* A set files itself under its first shingles in one global order, as many as make sure that two similar sets
share one; frequent shingles come last in that order, the most frequent at its end. A posting carries the set's size and
the shingle's position in it, and pairs of a list are left out by size and position where what is left from the position
on cannot reach the overlap asked for.

*Answers.* Equal sets are one. In each list the first set is compared with the others, and what it answers holds for
its whole component: sets that it links need no comparison with each other. Only sets of a list whose components still
differ afterwards are compared pair by pair, so a group of thousands of near copies costs a few comparisons for each.

*Sketches.* A set carries 512 bits, each the parity of the number of its shingles that fall there. Two sets differ in at
least as many shingles as their sketches in bits, so pairs whose sketches differ in more than the threshold allows are left
out, in the join of a list with itself and before texts are compared. No linked pair is.

Texts are shingled once; the first shingles of each are kept. Texts are read again rather than shuffled where they
hold frequent shingles or belong to a candidate pair; bitmaps of a fixed size say which.
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import staged
from daybook.llm.graph import components
from daybook.llm.substrings import BYTE, M1, M2, _chunks, _slices, bitmap, is_set, slots, stir

POWERS = np.array([pow(int(M1), i + 1, 1 << 64) for i in range(4096)], dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTERS = np.where(SPACE, np.uint64(0), BYTE)


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted 64-bit identifiers of the distinct k-word shingles; one for all words where there are fewer than k."""
    data = np.frombuffer(text.encode().lower(), np.uint8)  # folds A-Z only
    gap = SPACE[data]
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    data, starts = data[starts[0] :], (starts - starts[0]).astype(np.int32)
    lengths = np.diff(starts, append=np.int32(len(data)))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(starts, lengths)
    value = LETTERS[data] * POWERS[place & 4095]
    if lengths.max() > 4096:
        value *= np.uint64(2) * (place >> 12).astype(np.uint64) + np.uint64(1)
    word = stir(np.add.reduceat(value, starts))
    n = len(word) - k + 1
    if n < 1:
        return stir(np.add.reduce(word * POWERS[: len(word)], keepdims=True) + np.uint64(len(word)))
    out = word[:n] * POWERS[0]
    for i in range(1, k):
        out += word[i : i + n] * POWERS[i]
    out = stir(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_id(s: np.ndarray) -> np.int64:
    """One identifier of a whole set."""
    i = np.arange(len(s), dtype=np.uint64)
    return stir(np.add.reduce(stir(s + i * M2), keepdims=True) + np.uint64(len(s))).view(np.int64)[0]


def first_of(s: np.ndarray, threshold: int) -> int:
    """Number of shingles that a set files itself under, whatever the order."""
    return len(s) - -(-threshold * len(s) // 100) + 1 if len(s) else 0


def sketch(s: np.ndarray) -> np.ndarray:
    """512 parities of the shingles by their first nine bits, as eight integers."""
    return np.packbits(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1).view(np.int64)


def near(one: Column, n1: Column, two: Column, n2: Column, threshold: int) -> Column:
    """Whether two sets of these sketches and sizes may reach the threshold: then they differ in no more shingles than this."""
    apart = sum((F.bit_count(one[i].bitwiseXOR(two[i])) for i in range(1, 8)), F.bit_count(one[0].bitwiseXOR(two[0])))
    return (100 + threshold) * apart <= (100 - threshold) * (n1 + n2)


def hot_places(s: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``s`` are frequent, the ranks of those); ``hot`` has sorted identifiers and their ranks, rarest first."""
    ids, ranks = hot
    if not len(ids):
        return np.zeros(len(s), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(ids, s), len(ids) - 1)
    found = ids[at] == s
    return found, ranks[at[found]]


def ordered(s: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set in the global order: by identifier, then the frequent ones from rare to common."""
    found, ranks = hot_places(s, hot)
    return np.concatenate([s[~found], s[found][np.argsort(ranks)]])


def linked_pairs(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; ``texts`` (sid, packed) has every set named."""
    def f(batches):
        held, room = {}, 1 << 21  # shingles kept for pairs that name the same set again

        def of(sid, packed):
            nonlocal room
            if sid not in held:
                s = shingles(zlib.decompress(packed.as_py()).decode(), k)
                room -= len(s)
                if room < 0:
                    held.clear()
                    room = (1 << 21) - len(s)
                held[sid] = s
            return held[sid]

        for batch in batches:
            a, b, one, two = batch.columns
            ok = []
            for i, (p, q) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                x, y = of(p, one[i]), of(q, two[i])
                n = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * n >= threshold * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = texts.select(F.col("sid").alias("a"), F.col("packed").alias("one")), texts.select(F.col("sid").alias("b"), F.col("packed").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(f, "a long, b long")


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Fewer rows in a batch for Python while whole texts, or what is made of them, are in it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join(docs: DataFrame, k: int = 5, threshold: int = 75, hot_from: int = 64, hot_most: int = 100_000) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    Two rows link when 100 * |intersection| >= ``threshold`` * |union| of their sets of ``k``-word shingles; component_id
    is the smallest doc_id reachable. Null texts and texts without words have the empty set and link with nothing, so
    their component is their own id. Equal rows link. A null doc_id is the component only where no other id is in reach.
    No rows give no rows. ``hot_from`` and ``hot_most`` bound the table of frequent shingles that the order puts last;
    they change the work, not the result.
    """
    classed = classes(docs, k, threshold, hot_from, hot_most)
    least = classed.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return classed.join(least, "part", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame, k: int = 5, threshold: int = 75, hot_from: int = 64, hot_most: int = 100_000) -> DataFrame:
    """doc_id, text_id (xxhash64 of the text, null as empty), n_shingles, part for every row of ``docs``, as in ``join``.

    ``part`` names the group of linked sets; it is null where the set is empty.
    """
    with small_batches(docs.sparkSession, 500):
        return _classes(docs, k, threshold, hot_from, hot_most)


def _classes(docs: DataFrame, k: int, threshold: int, hot_from: int, hot_most: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_id"))

    def sized(frames):
        for f in _slices(frames):
            sets = [shingles(t, k) for t in f.text]
            yield pd.DataFrame({"doc_id": f.doc_id.astype("Int64"), "text_id": f.text_id, "sid": pd.array([set_id(s) if len(s) else None for s in sets], "Int64"),
                                "n_shingles": [len(s) for s in sets], "first": [s[: first_of(s, threshold)].view(np.int64) for s in sets],
                                "sketch": [sketch(s) for s in sets]})

    rows = staged(read.mapInPandas(sized, "doc_id long, text_id long, sid long, n_shingles long, first array<long>, sketch array<long>"), "sets")
    counted = staged(rows.select(F.explode("first").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "repeated-shingles")
    most = counted.where(F.col("n") >= hot_from).orderBy(F.desc("n"), "token").limit(hot_most).collect()
    ids, ranks = np.array([r.token for r in most], np.int64).view(np.uint64), np.arange(len(most))[::-1]
    by_id = np.argsort(ids)
    hot = context.broadcast((ids[by_id], ranks[by_id]))
    of_token = lambda f: slots(f.token.to_numpy(np.int64))
    seen = bitmap(counted, of_token, ["token"])
    refiled = None

    if most:
        def crowded(frames):
            """Texts with a frequent shingle among their first."""
            for f in frames:
                yield f.loc[[hot_places(x.view(np.uint64), hot.value)[0].any() for x in f["first"]], ["text_id"]]

        of_text = lambda f: slots(f.text_id.to_numpy(np.int64))
        again = context.broadcast(bitmap(rows.select("text_id", "first").mapInPandas(crowded, "text_id long"), of_text, ["text_id"]))

        def refile(frames):
            """The first shingles of those texts in the global order, and which of them were not there before."""
            for f in _slices(frames):
                out = []
                for t in f.text[is_set(again.value, of_text(f))]:
                    s = shingles(t, k)
                    n = first_of(s, threshold)
                    if hot_places(s[:n], hot.value)[0].any():
                        tokens = ordered(s, hot.value)[:n]
                        out.append((set_id(s), len(s), tokens.view(np.int64), tokens[tokens > s[n - 1]].view(np.int64)))
                yield pd.DataFrame(out, columns=["sid", "n_shingles", "first", "moved"])

        refiled = staged(read.select("text", "text_id").mapInPandas(refile, "sid long, n_shingles long, first array<long>, moved array<long>"), "refiled-sets")
        seen = seen | bitmap(refiled.select(F.explode("moved").alias("token")), of_token, ["token"])
    likely = context.broadcast(seen)

    def post(frames):
        def postings():
            for f in frames:
                for sid, n, first, final in zip(f.sid, f.n_shingles, f["first"], f.final, strict=True):
                    if not final and hot_places(first.view(np.uint64), hot.value)[0].any():
                        continue  # filed anew
                    at = np.flatnonzero(is_set(likely.value, slots(first)))
                    if len(at):
                        yield sid, np.full(len(at), n, np.int32), first[at], at.astype(np.int32)
        yield from _chunks(postings(), ["sid", "n", "token", "at"])

    filing = rows.where("sid is not null").select("sid", "n_shingles", "first", F.lit(False).alias("final"))
    if refiled is not None:
        filing = filing.unionByName(refiled.select("sid", "n_shingles", "first", F.lit(True).alias("final")))
    filed = filing.mapInPandas(post, "sid long, n int, token long, at int").distinct()
    # One pass over a list: its first set, and whether there is another.
    filed = staged(filed, "postings")
    # Long lists take their heads by one of 32 orders of the sets, so that those of one group do not all have the same one.
    drawn = F.struct(F.xxhash64("sid", F.col("token").bitwiseAND(F.lit(31))).alias("by"), "n", "sid", "at")
    heads = filed.groupBy("token").agg(F.min(F.struct("n", "sid", "at")).alias("least"), F.min(drawn).alias("drawn"), F.count("*").alias("sets")).where("sets > 1").select(
        "token", F.when(F.col("sets") < 8, F.col("least")).otherwise(F.struct("drawn.n", "drawn.sid", "drawn.at")).alias("head"))
    lists = staged(filed.join(heads, "token").select("token", "sid", "n", "at", "head"), "lists")

    def reaches(n1, at1, n2, at2):
        """Size and position leave room for the overlap that the threshold asks for, if no shingle before is shared.

        The first one that a linked pair shares always passes, and both sets are filed under it.
        """
        room = F.least(n1 - at1, n2 - at2)
        return (100 * F.least(n1, n2) >= threshold * F.greatest(n1, n2)) & ((100 + threshold) * room >= threshold * (n1 + n2))

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    c = F.col
    stars = lists.where((c("sid") != c("head.sid")) & reaches(c("n"), c("at"), c("head.n"), c("head.at"))).select(*pair(c("sid"), c("head.sid"))).distinct()
    sketches = staged(rows.where("sid is not null").select("sid", c("n_shingles").alias("size"), "sketch").dropDuplicates(["sid"]), "sketches")

    def likely_pairs(pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches leave room for the threshold."""
        one, two = (sketches.select(c("sid").alias(x), F.struct("size", "sketch").alias(f"_{x}")) for x in ("a", "b"))
        close = near(c("_a.sketch"), c("_a.size"), c("_b.sketch"), c("_b.size"), threshold)
        return pairs.join(one, "a").join(two, "b").where(close).select("a", "b")

    stars = staged(likely_pairs(stars), "head-pairs")

    def packed_texts(pairs: DataFrame) -> DataFrame:
        """sid, packed of every set that the pairs name, from another reading of the documents."""
        sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        named = staged(rows.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min("text_id").alias("text_id")), "named-sets")
        of_text = lambda f: slots(f.text_id.to_numpy(np.int64))
        wanted = context.broadcast(bitmap(named, of_text, ["text_id"]))

        def packed(frames):
            for f in _slices(frames):
                f = f[is_set(wanted.value, of_text(f))]
                yield pd.DataFrame({"text_id": f.text_id, "packed": [zlib.compress(t.encode(), 1) for t in f.text]})

        taken = read.select("text_id", "text").mapInPandas(packed, "text_id long, packed binary").dropDuplicates(["text_id"])
        return staged(taken.join(named, "text_id").select("sid", "packed"), "set-texts")

    packed = packed_texts(stars)
    links = staged(linked_pairs(stars, packed, k, threshold), "links")
    parts = components(links.select(c("a").alias("u"), c("b").alias("v")))

    # Lists whose sets are still in several components, compared pair by pair but for their heads.
    labelled = lists.join(parts, lists.sid == parts.node, "left").select("token", "sid", "n", "at", c("head.sid").alias("head"), F.coalesce("component", "sid").alias("part"))
    split = labelled.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("token")
    rest = staged(labelled.join(split, "token", "left_semi"), "split-lists")
    # Sets that share a token after the same token before met in that one's list, so a pair comes once for each run of shared tokens.
    before = F.lag("token").over(Window.partitionBy("sid").orderBy("at")).alias("before")
    sketched = rest.join(sketches.select("sid", "sketch"), "sid").select("token", "sid", "n", "at", "part", "sketch", before)
    x, y = sketched.alias("x"), sketched.alias("y")
    fresh = ~F.coalesce(c("x.before") == c("y.before"), F.lit(False))
    places = (c("x.n"), c("x.at"), c("y.n"), c("y.at"))
    more = x.join(y, (c("x.token") == c("y.token")) & (c("x.sid") < c("y.sid")) & (c("x.part") != c("y.part")) & fresh & reaches(*places)
                  & near(c("x.sketch"), c("x.n"), c("y.sketch"), c("y.n"), threshold)).select(c("x.sid").alias("a"), c("y.sid").alias("b")).distinct()
    more = staged(more.join(stars, ["a", "b"], "left_anti"), "more-pairs")
    packed = packed_texts(more)
    found = staged(linked_pairs(more, packed, k, threshold), "more-links")
    if found.limit(1).count():
        parts = components(links.unionByName(found).select(c("a").alias("u"), c("b").alias("v")))

    return rows.join(parts, rows.sid == parts.node, "left").select("doc_id", "text_id", "n_shingles", F.coalesce("component", "sid").alias("part"))
