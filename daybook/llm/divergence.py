"""How the sources of a language differ in their terms: exact divergences of every pair, and the terms that stand out.

Most of a pair's sum is the same constant for every term that neither source has. The rest are corrections, and they come from
a frequent-pattern tree: each kept term is a row of its nonzero counts in order of source, equal rows are one with a
multiplicity, and rows that begin alike share a path. With f(a, b) the value of a term that the group has a times and the other
source b times, the correction f(a, b) - f(a, 0) - f(0, b) + f(0, 0) of two counts is computed once for each node and ancestor,
times the node's multiplicity; what hangs on one count alone comes from a histogram of counts per group.

The tree is dealt by ranges of its sorted rows, so a path that many terms share is split, and its parts add up. A task walks
its rows in order, which is the tree depth first: only the path from the root is held.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import staged

SCALE = 1_000_000_000
#: Bytes that make terms: ASCII letters, lower-cased, and everything beyond ASCII.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTED = "lang string, source string, term string, n long, df long"
CORRECTED = "lang string, source string, item string, high long, low long"


#: A term's occurrences and documents while they are counted: one number, documents above this bit.
DOCUMENT = 1 << 40


def _counted(batches: Iterable[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), summed until ``most`` are held; '' marks the group itself."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            counts = np.fromiter(terms.values(), np.int64, len(terms))
            group = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            names = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.record_batch([*group, names, pa.array(counts % DOCUMENT), pa.array(counts // DOCUMENT)], names=["lang", "source", "term", "n", "df"])
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0), batch.column(1)
        texts = batch.column(2).cast(pa.large_binary())
        for i in range(batch.num_rows):
            terms = held.setdefault((langs[i].as_py(), sources[i].as_py()), {b"": 0})
            size -= len(terms)
            get = terms.get
            for t, n in Counter(texts[i].as_py().translate(TERM_BYTES).split()).items():
                terms[t] = get(t, 0) + n + DOCUMENT
            size += len(terms)
            if size > most:
                yield from given()
                size = 0
    yield from given()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df: occurrences and documents of each term; term '' stands once for each group."""
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return filled.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a term found ``n`` times in ``total`` occurrences of ``kept`` terms, exact: the product is a DECIMAL."""
    return F.call_function("div", (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + kept).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of two shares, each below 2^30 + 2: the square stays within a long."""
    return F.call_function("div", (p - q) * (p - q), q)


class Tree:
    """The open path of the tree, and pairs of a complete node and an ancestor that wait to be corrected together."""

    #: A node of more rows is corrected in Python integers; below, sums of WAITING products stay within 64 bits.
    MOST_TIMES, WAITING = 1 << 12, 1 << 18

    def __init__(self) -> None:
        self.sums: dict[tuple[int, int], int] = {}
        self.path: list[int] = []
        self._nodes([], [], [], [])

    def _nodes(self, group, p, p0, times) -> None:
        self.group, self.p, self.p0, self.times = group, p, p0, times
        self.below, self.above = [], []

    def insert(self, group: int, p: int, p0: int) -> None:
        self.path.append(len(self.p))
        self.group.append(group)
        self.p.append(p)
        self.p0.append(p0)
        self.times.append(0)

    def close(self, depth: int) -> None:
        """Nodes below ``depth`` are complete: pair each with its ancestors and hand its multiplicity up."""
        while len(self.path) > depth:
            i = self.path.pop()
            if not self.path:
                return
            self.times[self.path[-1]] += self.times[i]
            if self.times[i] > self.MOST_TIMES:
                self._exact(i)
                continue
            self.below += [i] * len(self.path)
            self.above += self.path
            if len(self.below) > self.WAITING:
                self.correct()

    def _add(self, a: int, b: int, value: int) -> None:
        self.sums[a, b] = self.sums.get((a, b), 0) + value

    def _exact(self, i: int) -> None:
        f = lambda p, q: (p - q) ** 2 // q
        for j in self.path:
            for x, y in ((i, j), (j, i)):
                p, p0, q, q0 = self.p[x], self.p0[x], self.p[y], self.p0[y]
                self._add(self.group[x], self.group[y], self.times[i] * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)))

    def correct(self) -> None:
        """All waiting pairs at once. The four terms are below 2^60 each, so a correction is a 64-bit number, summed in two halves."""
        group, p, p0, times = (np.array(x, dtype=np.int64) for x in (self.group, self.p, self.p0, self.times))
        i, j = np.array(self.below, dtype=np.int64), np.array(self.above, dtype=np.int64)
        f = lambda a, b: (a - b) ** 2 // b
        for x, y in ((i, j), (j, i)) if len(i) else ():
            value = f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y])
            keys, at = _pairs(group[x], group[y])
            high, low = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            np.add.at(high, at, (value >> 32) * times[i])
            np.add.at(low, at, (value & 0xFFFFFFFF) * times[i])
            for (a, b), h, n in zip(keys, high.tolist(), low.tolist(), strict=True):
                self._add(a, b, (h << 32) + n)
        open_ = self.path
        self._nodes(*([x[k] for k in open_] for x in (self.group, self.p, self.p0, self.times)))
        self.path = list(range(len(open_)))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Distinct pairs of group numbers (below 2^31) and the place of each pair among them."""
    both, at = np.unique((a << 31) | b, return_inverse=True)
    return [(int(x) >> 31, int(x) & 0x7FFFFFFF) for x in both], at


def _corrections(batches: Iterable[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Walk sorted rows (lang, counts, times) as a tree; per (lang, source, item) the corrections of all nodes and ancestors."""
    tree, numbers, groups = Tree(), {}, []
    lang, prefix = None, []  # (source, n) of the open path

    def given() -> pa.RecordBatch:
        keys, values = list(tree.sums), list(tree.sums.values())
        tree.sums.clear()
        cols = [[groups[a][0] for a, _ in keys], [groups[a][1] for a, _ in keys], [groups[b][1] for _, b in keys], [v >> 32 for v in values], [v & 0xFFFFFFFF for v in values]]
        types = [pa.string()] * 3 + [pa.int64()] * 2
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["lang", "source", "item", "high", "low"])

    for batch in batches:
        langs, counts, times = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
        ends = counts.offsets.to_pylist()
        base = ends[0]
        sources, ns, ps, p0s = (c.to_pylist() for c in counts.flatten().flatten())
        for row, (row_lang, n_rows) in enumerate(zip(langs, times, strict=True)):
            start, stop = ends[row] - base, ends[row + 1] - base
            shared = 0
            if row_lang == lang:
                most_shared = min(len(prefix), stop - start)
                while shared < most_shared and prefix[shared] == (sources[start + shared], ns[start + shared]):
                    shared += 1
            tree.close(shared)
            del prefix[shared:]
            lang = row_lang
            for k in range(start + shared, stop):
                prefix.append((sources[k], ns[k]))
                group = numbers.get((lang, sources[k]))
                if group is None:
                    group = numbers[lang, sources[k]] = len(groups)
                    groups.append((lang, sources[k]))
                tree.insert(group, ps[k], p0s[k])
            tree.times[tree.path[-1]] += n_rows
            if len(tree.sums) > most:
                # Sums go out in parts; the open path stays.
                yield given()
    tree.close(0)
    tree.correct()
    if tree.sums:
        yield given()


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank for ``docs`` (lang, source, text; other columns are ignored).

    Part ``pair`` gives each other source of the language with its divergence, part ``term`` the ``most_terms`` terms that a
    group has more of than its language. Nulls count as ''. A group without terms, or of a language that keeps none (fewer
    than ``least_docs`` documents hold each), stands with its pairs; a language of one source has no pairs. Repeated rows
    count each. No rows give none. Ties go by the item's UTF-8 bytes. Values are exact; sums run in DECIMAL(38, 0).
    The output itself has a row for each ordered pair of a language's sources.
    """
    counted = staged(term_counts(docs), "divergence-terms")
    named = counted.where("term <> ''")
    kept = named.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least_docs).drop("df")
    kept = staged(kept, "divergence-kept")
    found = named.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    p0 = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    groups = staged(groups.withColumn("p0", p0), "divergence-groups")  # one row for each group
    shares = staged(found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "p0", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "divergence-shares")

    value = distance(F.col("p"), F.col("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)

    # The tree: rows of counts in order of source, equal ones once, dealt by ranges of their order.
    rows = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n", "p", "p0"))).alias("counts"))
    rows = rows.groupBy("lang", "counts").agg(F.count("*").alias("times"))
    walked = rows.repartitionByRange("lang", "counts").sortWithinPartitions("lang", "counts").mapInArrow(_corrections, CORRECTED)
    decimal = lambda c: F.col(c).cast("decimal(38,0)")
    joint = walked.select("lang", "source", "item", (decimal("high") * F.lit(1 << 32).cast("decimal(10,0)") + decimal("low")).cast("decimal(38,0)").alias("value"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    times = lambda f, n: (f.cast("decimal(19,0)") * n.cast("decimal(19,0)")).cast("decimal(38,0)")
    base = groups.select("lang", "source", "p0", "v").join(other, "lang").where("source <> item").select(
        "lang", "source", "item", F.coalesce(times(distance(F.col("p0"), F.col("q0")), F.col("v")), F.lit(0).cast("decimal(38,0)")).alias("value"))
    single = shares.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("times"))
    against = single.join(other, "lang").where("source <> item")
    with_zero = lambda p, q: distance(p, q) - distance(F.col("p0"), F.col("q0"))
    as_group = against.select("lang", "source", "item", times(with_zero(F.col("p"), F.col("q0")), F.col("times")).alias("value"))
    # The same counts seen from the other group, whose own count is 0: its p is q0, the counted source gives q.
    as_item = against.select(
        "lang", F.col("item").alias("source"), F.col("source").alias("item"),
        times(distance(F.col("q0"), F.col("p")) - distance(F.col("q0"), F.col("p0")), F.col("times")).alias("value"))
    summed = base.unionByName(joint).unionByName(as_group).unionByName(as_item).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    return ranked.select("lang", "source", "part", "item", "value", "rank").unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
