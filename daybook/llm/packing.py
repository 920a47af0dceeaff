"""Packing into sequences of a fixed capacity by bin completion with branch and bound.

Only lengths matter to a packing, and there are at most ``capacity`` of them: the search runs over the histogram of
lengths, so what reaches the driver is bounded whatever the input. It takes the largest length left, enumerates
undominated fillings around it, repeats the best one as often as the counts allow, and branches over the rest, pruned by
the waste that an incumbent (best-fit decreasing) leaves. Pieces then get their place by their rank among pieces of equal
length, which Spark counts in buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm import tokens
from daybook.llm.common import staged

Filling = tuple[tuple[int, int], ...]  # (length, how many), descending


def best_fit(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over single pieces; for the remainder of a packing."""
    bins: list[tuple[int, list[int]]] = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [(room, i) for i, (room, _) in enumerate(bins) if room >= length]
        if fits:
            room, i = min(fits)
            bins[i] = (room - length, [*bins[i][1], length])
        else:
            bins.append((capacity - length, [length]))
    return [own for _, own in bins]


def fillings(counts: dict[int, int], room: int, most_waste: int, tries: int = 1000, keep: int = 12) -> list[tuple[int, Filling]]:
    """(waste, filling) for ``room``, least waste first, none dominated: no larger piece left would fit in place of one of it.

    Depth-first from large to small, so that the first fillings use large pieces; ends at waste 0 or after ``tries`` steps.
    """
    lengths = sorted((x for x, n in counts.items() if n > 0 and x <= room), reverse=True)
    if not lengths:
        return [(room, ())] if room <= most_waste else []
    found: dict[Filling, int] = {}
    steps = 0
    least = lengths[-1]

    def walk(i: int, left: int, taken: list[tuple[int, int]]) -> bool:
        nonlocal steps
        steps += 1
        if left < least or i >= len(lengths):
            # Maximal only if nothing left fits; the walk below always takes as many as it can of the last length.
            have = dict(taken)
            fits = left >= least and any(counts[x] > have.get(x, 0) for x in takewhile(lambda x: x <= left, reversed(lengths)))
            if not fits and left <= most_waste:
                found[tuple(taken)] = left
            return left == 0 or len(found) >= 50 * keep
        if steps > tries:
            return True
        exact = left if counts.get(left, 0) > 0 and left <= lengths[i] else None
        if exact is not None:
            found[(*taken, (exact, 1))] = 0
            return True
        while i < len(lengths) and lengths[i] > left:
            i += 1
        if i >= len(lengths):
            return walk(i, left, taken)
        x = lengths[i]
        for n in range(min(counts[x], left // x), -1, -1):
            if walk(i + 1, left - n * x, [*taken, (x, n)] if n else taken):
                return True
        return False

    walk(0, room, [])
    return sorted((w, f) for f, w in found.items())[:keep]


def branch(counts: dict[int, int], capacity: int, nodes: int = 2000) -> list[list[int]]:
    """Fewest bins for a small remainder: branch and bound over bin completions, best-fit decreasing as incumbent."""
    best = best_fit(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    bound = -(-total // capacity)
    budget = nodes

    def search(left: dict[int, int], bins: list[list[int]], waste: int) -> bool:
        nonlocal best, budget
        budget -= 1
        if not left:
            if len(bins) < len(best):
                best = bins
            return len(best) == bound
        allowed = (len(best) - 1) * capacity - total - waste
        if allowed < 0 or budget < 0:
            return budget < 0
        top = max(left)
        rest = {x: n - (x == top) for x, n in left.items() if n > (x == top)}
        for w, filling in fillings(rest, capacity - top, allowed, tries=200):
            after = {x: n - dict(filling).get(x, 0) for x, n in rest.items() if n > dict(filling).get(x, 0)}
            if search(after, [*bins, [top, *(x for x, n in filling for _ in range(n))]], waste + w):
                return True
        return False

    if len(best) > bound:
        search({x: n for x, n in counts.items() if n}, [], 0)
    return best


def plan(histogram: dict[int, int], capacity: int, tail: int = 48) -> list[tuple[int, Filling]]:
    """(how often, filling) for all pieces; ``tail`` is how many pieces are left to the branch and bound."""
    left = {x: n for x, n in histogram.items() if n > 0}
    out: list[tuple[int, Filling]] = []
    while left and sum(left.values()) > tail:
        top = max(left)
        rest = {x: n - (x == top) for x, n in left.items() if n > (x == top)}
        filling = dict(fillings(rest, capacity - top, capacity)[0][1]) if capacity > top else {}
        filling[top] = filling.get(top, 0) + 1
        # Repeat while the counts last, but leave the tail something to branch over.
        times = max(1, min(left[x] // n for x, n in filling.items()) if sum(left.values()) > 4 * tail else 1)
        out.append((times, tuple(sorted(filling.items(), reverse=True))))
        left = {x: n - times * filling.get(x, 0) for x, n in left.items() if n > times * filling.get(x, 0)}
    for own in branch(left, capacity):
        out.append((1, tuple(sorted(((x, own.count(x)) for x in set(own)), reverse=True))))
    return out


def places(planned: list[tuple[int, Filling]]) -> dict[str, np.ndarray]:
    """For each (length, run of ranks): the first sequence, pieces of that length in a sequence, and the offset of the first."""
    rows, used, sequence = [], {}, 0
    for times, filling in planned:
        offset = 0
        for x, n in filling:
            rows.append((x, used.get(x, 0), sequence, n, offset))
            used[x] = used.get(x, 0) + times * n
            offset += x * n
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Documents as pieces; only those over the capacity are cut, the first piece holding the remainder."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i in range(0, len(frame), 2000):
                part = frame.iloc[i : i + 2000]
                for doc_id, raw in zip(part.doc_id.astype("Int64"), tokens.encode(part.text, tokenizer, end_id), strict=True):
                    n = len(raw) // 4
                    stops = list(range(n % capacity or capacity, n + 1, capacity)) if n > capacity else [n]
                    for k, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs`` (doc_id, text).

    Null is the empty text: one piece of the end id alone. Repeated rows are packed as often as they occur; a null doc_id
    is carried along. Other columns are ignored. No rows give no rows.
    """
    pieces = staged(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    if not histogram:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = places(plan(histogram, capacity))
    buckets = 64 + sum(histogram.values()) // bucket_rows
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    upto = Window.partitionBy("length").orderBy("bucket")
    bases = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", (F.sum("n").over(upto) - F.col("n")).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(own) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        x, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(table["key"], (x << 44) + r, side="right") - 1
        nth = r - table["rank"][i]
        return pd.DataFrame({"sequence_id": table["sequence"][i] + nth // table["each"][i], "offset": table["offset"][i] + nth % table["each"][i] * x})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", place("length", "rank").alias("p")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")
