"""Document fingerprints by Order MinHash. DataFrame operations only.

1. A text becomes tokens (runs of letters, runs of digits, every other character but the space by itself) and a k-mer
   starts at every token; near the end of the text it is shorter.
2. k-mers are numbered by occurrence: sorted by (k-mer, place), the number is the distance to the first of the run, found by
   doubling steps back.
3. Each (k-mer, number) gets one hash. The hash space is a ring of ``COMPONENTS`` arcs; a component takes the ``PICKED``
   smallest hashes from the start of its arc on, over the end of the arc where the text is too short to fill it.
4. Picked k-mers go back into text order and the tuple is hashed: a component agrees only where the same k-mers are
   picked in the same order, so moving text about lowers the likeness as changing it does.

A packed value is 36 bits of hash and 27 bits of place, so sorting one is sorting primitive longs. A text may have
134 million tokens; k-mers of one text that agree in 36 bits of hash count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import staged

#: Scripts written without spaces, whose characters are tokens each.
UNSPACED = r"\u0E00-\u0E7F\u1100-\u11FF\u2E80-\uD7FF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
TOKEN = rf"(?s)[A-Za-z[\p{{L}}\p{{M}}&&[^{UNSPACED}]]]{{1,24}}+|[0-9]{{1,24}}+|[^ ]"
KMER = 3
PICKED = 2
ARC_BITS = 6
COMPONENTS = 1 << ARC_BITS
PLACE_BITS = 27
HEX = 4


PLACES = (1 << PLACE_BITS) - 1
HASHES = (1 << 63) - 1 - PLACES
#: Arcs differ where two packed values do from this bit on.
ARC_STEP = 1 << (63 - ARC_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACES))


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(HASHES)).bitwiseOR(place)


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later expressions read as it is: generated from a one-entry array, it is never inlined into their lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _numbered(sorted_: Column, steps: Column):
    """Entry i of the sorted array, hashed anew with its occurrence number unless that is 0: how far back the same k-mer goes."""
    def of(x: Column, i: Column) -> Column:
        same = lambda back: x.bitwiseXOR(F.get(sorted_, i - back)) <= PLACES
        far = F.aggregate(steps, F.lit(0), lambda d, s: F.when(same(d + s), d + s).otherwise(d))
        number = F.when(same(F.lit(2)), far).otherwise(F.lit(1))
        return F.when(same(F.lit(1)), _packed(F.xxhash64(x.bitwiseAND(F.lit(HASHES)), number), _place(x))).otherwise(x)
    return of


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as ``out``: COMPONENTS groups of HEX digits, '' where there is no token.

    Null counts as empty. Columns whose names start with ``_omh_`` are replaced.
    """
    kept = [c for c in df.columns if c != out]
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    # A lambda over a one-entry array binds the tokens, so that the text is matched once.
    kmers = lambda ts: F.transform(ts, lambda t, i: _packed(F.xxhash64(t, *[F.get(ts, i + j) for j in range(1, KMER)]), i.cast("long")))
    df = df.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.transform(F.array(tokens), kmers)).alias("_omh_kmers"))
    df = _bound(df, "_omh_sorted", F.sort_array("_omh_kmers"))
    # Doubling steps that fit the text, largest first.
    digits = F.length(F.bin(F.size("_omh_kmers")))
    df = _bound(df, "_omh_steps", F.slice(F.array(*[F.lit(1 << s) for s in range(PLACE_BITS - 1, -1, -1)]), PLACE_BITS - digits + 1, digits))
    df = _bound(df, "_omh_numbered", F.transform("_omh_sorted", _numbered(F.col("_omh_sorted"), F.col("_omh_steps")))).drop("_omh_sorted")
    df = _bound(df, "_omh_ring", F.sort_array("_omh_numbered")).drop("_omh_numbered")

    n = F.size("_omh_ring")
    before = lambda j: F.aggregate("_omh_steps", F.lit(0), lambda p, s: F.when(F.get("_omh_ring", p + s - 1) < j * ARC_STEP, p + s).otherwise(p))

    def component(start: Column) -> Column:
        places = [_place(F.get("_omh_ring", F.pmod(start + t, n))) for t in range(PICKED)]
        of = lambda p: F.get("_omh_kmers", p.cast("int")).bitwiseAND(F.lit(HASHES))
        picked = F.transform(F.sort_array(F.slice(F.array(*places), F.lit(1), n)), of)
        return F.substring(F.hex(F.xxhash64(picked).bitwiseOR(F.lit(1 << 62))), 17 - HEX, HEX)

    every = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(COMPONENTS - 1).cast("long")), lambda j: component(before(j))), "")
    return df.select(*[F.col(f"`{c}`") for c in kept], F.when(n > 0, every).otherwise(F.lit("")).alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of equal components, 0 to 1. Two texts without tokens are alike (1), one without is unlike any other (0)."""
    part = lambda c, j: F.substr(F.col(c), j * HEX + 1, F.lit(HEX))
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(COMPONENTS - 1)), lambda j: part(a, j) == part(b, j)))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0)).otherwise(equal / F.lit(float(COMPONENTS)))


def _previous(rows: DataFrame) -> DataFrame:
    """_row, prev, prev_n: the distinct row before each one in order of (doc_id, _row), before the first the last.

    Only ids move: they are range-partitioned, and each range takes its border from the last row of the one before it.
    """
    ids = rows.groupBy("_row").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"))
    ids = staged(ids.repartitionByRange("doc_id", "_row").withColumn("range", F.spark_partition_id()), "omh-ids")
    whole = F.struct("doc_id", "_row", "n_chars")
    ends = ids.groupBy("range").agg(F.max(whole).alias("end"))  # one row per partition
    in_order = Window.orderBy("range")
    last = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    borders = ends.select("range", F.coalesce(F.lag("end").over(in_order), last).alias("border"))
    inside = Window.partitionBy("range").orderBy("doc_id", "_row")
    led = ids.withColumn("before", F.lag(whole).over(inside)).join(borders, "range")
    p = F.coalesce("before", "border")
    return led.select(F.col("_row").alias("at"), p["_row"].alias("prev"), p["n_chars"].alias("prev_n"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by doc_id (null first), rows of one id by the md5 of id and text; after the last comes the
    first, and a single row is its own next. Rows that are equal in both are computed once and given out as often as
    they stand there, each followed by its copy, the last by the next other row. Null text is empty. No rows give none.
    """
    text = F.coalesce("text", F.lit(""))
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))
    given = docs.select("doc_id", text.alias("text"), row.alias("_row"), F.char_length(text).cast("long").alias("n_chars"))
    previous = _previous(given)
    told = with_fingerprint(given, "text", "fingerprint")
    # One struct, so that both uses read the same columns and their shuffle of texts is one.
    whole = F.first(F.struct("doc_id", "text", "n_chars", "fingerprint")).alias("doc")
    distinct = told.groupBy("_row").agg(whole, F.count("*").alias("copies")).where("copies > 0").select("_row", "doc", "copies")
    heads = distinct.join(previous, F.col("_row") == F.col("at")).select(
        F.col("prev").alias("_row"), F.substr("doc.text", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("head"), F.col("doc.fingerprint").alias("next_fingerprint"))
    both = distinct.join(heads, "_row").select("doc.*", "copies", "head", "next_fingerprint")
    own = F.struct(F.lit(1).cast("long").alias("times"), F.col("head"), F.col("next_fingerprint"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    self_ = F.struct((F.col("copies") - 1).alias("times"), F.substr("text", F.lit(1), cut).alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    cases = F.when(F.col("copies") > 1, F.array(own, self_)).otherwise(F.array(own))
    cased = both.select("doc_id", "text", "n_chars", "fingerprint", F.explode(cases).alias("case")).select("doc_id", "text", "n_chars", "fingerprint", "case.*")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), "head")
    cased = _bound(cased, "edited", edited).drop("text", "head")
    cased = cased.withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    out = with_fingerprint(cased, "edited", "edited_fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"), "times")
    # Copies are dealt out in strides, so that no long array of them is ever held.
    strides = out.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(10_000).cast("long"))))
    return strides.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("times") - F.col("from"), F.lit(10_000))))).drop("times", "from", "copy")
