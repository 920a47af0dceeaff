"""Benchmark decontamination as a prefix-filtered set join. DataFrame operations only.

A window is ``width`` consecutive words of an item, or a whole shorter item. A document holds a window only if it holds
every shingle of it, so the prefix of a window, its shingles ordered by rarity, needs one token: the rarest shingle.
The length bound keeps windows that fit the document, the positional bound those whose start, given by the shingle's
place in both, leaves room; what is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingle_hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each place, in order; empty where there are fewer than k words."""
    n = F.size(words) - k + 1
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.array().cast("array<long>"))


def windows_of(benchmark: DataFrame, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(distinct windows with their length and shingle length; item ids of each window)."""
    items = benchmark.select("item_id", F.explode(F.array(words_of(F.col("text")))).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    spans = items.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.slice("words", i + 1, F.lit(width)))).alias("window"))
    owned = spans.withColumn("window_id", F.xxhash64("window")).distinct()
    distinct = owned.select("window_id", "window").distinct().select(
        "window_id", "window", F.size("window").alias("length"), F.least(F.size("window"), F.lit(k)).alias("k"))
    return staged(distinct, "windows"), owned.select("window_id", "window", "item_id")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_id.

    ``k`` is the shingle length of the join tokens; ``broadcast_rows`` bounds the token table that may be broadcast (a
    token is two numbers; beyond the bound it is joined by shuffle). A row is its doc_id and its text (``text_id``, a
    64-bit hash of it): rows that share a doc_id, null included, are judged each by its own text. Null or empty texts have
    no words and no hits; items without words have no windows; a null item_id counts as no item. No documents give no
    rows, no items give no hits. Other columns are ignored.
    """
    windows, owned = windows_of(benchmark, width, k)
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())  # at most k numbers
    text_id = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id")
    spread = docs.select("doc_id", text_id, words_of(F.col("text")).alias("words"))

    def located(ws: DataFrame) -> DataFrame:
        """Every shingle of the windows with its offset."""
        parts = [ws.where(F.col("k") == n).select("window_id", "window", "length", F.posexplode(shingle_hashes(F.col("window"), n)).alias("offset", "token")) for n in lengths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    if not lengths:
        hits = docs.sparkSession.createDataFrame([], "doc string, text_key long, n_hit long, n_items long, items_sha256 string")
        return _joined(spread.select("doc_id", "text_id", F.size("words").cast("long").alias("n_words")), hits)
    tokens = staged(located(windows), "tokens")
    known = tokens.select("token").distinct().withColumn("known", F.lit(True))
    small = known.count() <= broadcast_rows
    placed = lambda w: [F.transform(shingle_hashes(w, n), lambda h, i: F.struct(i.alias("place"), h.alias("token"))) for n in lengths]
    # Place -1 stands for the document itself, so that one pass over the texts gives the counts as well.
    itself = F.array(F.struct(F.lit(-1).alias("place"), F.lit(None).cast("long").alias("token")))
    # A one-entry array binds the words, so that they are split once and not again for each shingle.
    shingles = docs.select("doc_id", text_id, F.inline(F.transform(
        F.array(words_of(F.col("text"))), lambda w: F.struct(w.alias("words"), F.size(w).alias("n"), F.concat(itself, *placed(w)).alias("shingles")))))
    near = shingles.select("doc_id", "text_id", "words", "n", F.inline("shingles"))
    # Words around a shingle, with room for any window that holds it.
    low = F.greatest(F.col("place") - (width - 1), F.lit(0))
    if small:
        met = near.join(F.broadcast(known), "token", "left").where("known or place < 0").select(
            "doc_id", "text_id", "n", "place", "token", F.when(F.col("place") >= 0, F.slice("words", low + 1, F.lit(2 * width - 1))).alias("around"))
        met = staged(met, "shingle-hits")
        counts = met.where("place < 0").select("doc_id", "text_id", F.col("n").cast("long").alias("n_words"))
        met = met.where("place >= 0")
    else:
        met = staged(near.drop("words").where("place >= 0").join(known, "token", "left_semi"), "shingle-hits")
        counts = spread.select("doc_id", "text_id", F.size("words").cast("long").alias("n_words"))

    # Rarity of each benchmark shingle over all documents, then one token, the rarest, for each window.
    sized = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    rarity = met.groupBy("token").agg(F.count("*").alias("seen"))
    prefix = staged(
        tokens.join(rarity, "token", "left").groupBy("window_id", "window", "length")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset")).alias("rarest"), F.min(F.coalesce("seen", F.lit(0))).alias("least"))
        .where("least > 0").select("window_id", "window", "length", "rarest.token", "rarest.offset"), "prefix")
    start = F.col("place") - F.col("offset")
    pairs = met.join(sized(prefix), "token").where((start >= 0) & (start + F.col("length") <= F.col("n"))).withColumn("start", start)
    if small:
        held = F.slice("around", F.col("start") - low + 1, F.col("length"))
    else:
        pairs = pairs.drop("n").distinct().alias("p").join(
            spread.dropDuplicates(["doc_id", "text_id"]).alias("s"), F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("p.text_id") == F.col("s.text_id"))).select("p.*", "s.words")
        held = F.slice("words", F.col("start") + 1, F.col("length"))
    occurs = staged(pairs.where(held == F.col("window")).select(F.col("doc_id").cast("string").alias("doc"), F.col("text_id").alias("text_key"), "window_id", "start", "length"), "occurrences")

    # Union of the hit intervals: per document the distinct (start, length) pairs, at most a few per word of its text.
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "length"))), F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("hit")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["start"] + s["length"]).alias("upto"),
            (a["hit"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["upto"], s["start"]))).alias("hit")), lambda a: a["hit"])
    covered = occurs.groupBy("doc", "text_key").agg(merged.alias("n_hit"))
    named = occurs.select("doc", "text_key", "window_id").distinct().join(owned.where("item_id is not null").select("window_id", F.col("item_id").cast("string").alias("item")), "window_id")
    items = named.groupBy("doc", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = covered.alias("c").join(items.alias("i"), F.col("c.doc").eqNullSafe(F.col("i.doc")) & (F.col("c.text_key") == F.col("i.text_key")), "left").select(
        "c.doc", "c.text_key", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"))
    return _joined(counts, hits)


def _joined(counts: DataFrame, hits: DataFrame) -> DataFrame:
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counts.join(hits, F.col("doc_id").cast("string").eqNullSafe(F.col("doc")) & (F.col("text_id") == F.col("text_key")), "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.greatest(F.coalesce("n_items", F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"), "text_id")
