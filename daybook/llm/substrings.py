"""Removal of repeated byte strings with a suffix order refined by bucket pointers.

Two places fall in one bucket at depth h if their next h bytes are equal. A bucket is named by a 64-bit identifier made
from the identifiers at half the depth, at the place and at a later offset; each refinement reuses the ones before. No
suffix is sorted that cannot matter:

1. *Initial buckets.* At depth Q every place has an identifier. Each string of LENGTH bytes is filed under its smallest
   (leftmost) one, its anchor, so equal strings are filed alike, and neighbouring strings that share an anchor form a run.
   Buckets with one run are dropped.
2. *Stretches.* A run that spans the same stretch of bytes as another of its bucket is settled with all its strings.
3. *Blocks.* Buckets with several stretches are refined by blocks of STEP strings, one representative run for each
   stretch: the bytes that all strings of a block share (core) and those that any of them has (cover). A core of its own
   ends the search, an equal cover settles the block.
4. *Strings.* Only blocks with a common core and different covers are refined string by string to depth LENGTH.

Identifiers are compared within a bucket, that is on 128 bits. Every shuffle is by an identifier or a text and
pre-aggregated; nothing is gathered for a whole bucket. Documents are read again rather than shuffled for 1 to 3: bitmaps
of a fixed size say which runs are worth emitting, and a bit set by chance costs a row, not the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import staged

Q, STEP = 32, 16
BITS = 1 << 24  # of a bitmap: 2 MB for the driver and each executor, whatever the input
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= M1
    x ^= x >> np.uint64(29)
    return x


BYTE = stir((np.arange(256, dtype=np.uint64) + np.uint64(1)) * M2)


def deeper(h: np.ndarray, at: int, to: int) -> np.ndarray:
    """Identifiers at depth ``to`` from those at depth ``at`` (powers of two); each level reads the one before at a later offset."""
    while at < to:
        if h.shape[-1] <= at:
            return h[..., :0]
        up = h[..., :-at] * np.uint64(pow(int(M2), at, 1 << 64))
        up += h[..., at:]
        h, at = up, at * 2
    return h


def strings(b128: np.ndarray, length: int) -> np.ndarray:
    """Identifiers at depth ``length`` (128 to 256) from two overlapping ones at depth 128."""
    shift = length - 128
    return stir(b128[..., : max(0, b128.shape[-1] - shift)] * M1 + stir(b128[..., shift:]))


def anchors(b: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor) of each run among n strings: the leftmost smallest identifier at depth Q inside each string."""
    w = length - Q + 1
    low = stir(b)
    low &= np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(len(b), dtype=np.uint64)
    at = 1
    while at * 2 <= w:
        low, at = np.minimum(low[:-at], low[at:]), at * 2
    anchor = np.minimum(low[:n], low[w - at : w - at + n])
    anchor = (anchor & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return first, np.concatenate([first[1:], [n]]) - 1, anchor[first]


def _texts(frames: Iterator[pd.DataFrame], length: int):
    """(key, bytes, identifiers at depth Q, first, last, anchor) of each text that is long enough."""
    for frame in frames:
        for key, text in zip(frame.key, frame.text, strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            if len(data) >= length:
                b = deeper(BYTE[data], 1, Q)
                yield key, data, b, *anchors(b, len(data) - length + 1, length)


def _chunks(rows: Iterator[tuple], columns: list[str], most: int = 100_000) -> Iterator[pd.DataFrame]:
    """Frames of about ``most`` rows from tuples of (key, arrays ...)."""
    held, n = [], 0

    def frame() -> pd.DataFrame:
        sizes = [len(h[1]) for h in held]
        out = {columns[0]: np.repeat([h[0] for h in held], sizes)}
        return pd.DataFrame(out | {c: np.concatenate([h[i + 1] for h in held]) for i, c in enumerate(columns[1:])})

    for row in rows:
        held.append(row)
        n += len(row[1])
        if n >= most:
            yield frame()
            held, n = [], 0
    if held:
        yield frame()


def slots(bucket: np.ndarray) -> np.ndarray:
    return (stir(bucket.view(np.uint64) * M2) >> np.uint64(40)).astype(np.int64) & (BITS - 1)


def place_slots(key, first) -> np.ndarray:
    return slots((np.atleast_1d(first).astype(np.uint64) * M1 + np.atleast_1d(key).view(np.uint64) * M2).view(np.int64))


def padded(pieces: list[bytes], width: int) -> np.ndarray:
    """Rows of byte identifiers, filled up to one width."""
    return BYTE[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)]


def _slices(frames: Iterator[pd.DataFrame], n: int = 2000) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for i in range(0, len(frame), n):
            yield frame.iloc[i : i + n]


def bitmap(df: DataFrame, to_slots, schema_in: list[str]) -> np.ndarray:
    """BITS bits, set at the slots of the rows; at most BITS / 64 rows reach the driver."""
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"slot": to_slots(frame)})

    rows = df.select(*schema_in).mapInPandas(f, "slot long").groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    got = rows.toPandas()
    out[got.word.to_numpy(np.int64)] = got.bits.to_numpy(np.int64)
    return out.view(np.uint64)


def is_set(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0


RUN = ["first", "last", "anchor", "bucket", "stretch"]
RUNS = "key long, first int, last int, anchor int, bucket long, stretch long"


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """key, first, last: the strings of ``length`` bytes starting at first..last of text ``key`` also start elsewhere."""
    context = texts.sparkSession.sparkContext

    def initial(frames):
        for f in _chunks(((key, b[anchor].view(np.int64)) for key, _, b, _, _, anchor in _texts(frames, length)), ["key", "bucket"]):
            yield f[["bucket"]]

    repeated = texts.mapInPandas(initial, "bucket long").groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    likely = context.broadcast(bitmap(repeated, lambda f: slots(f.bucket.to_numpy(np.int64)), ["bucket"]))

    def runs(frames):
        def rows():
            for key, _, b, first, last, anchor in _texts(frames, length):
                bucket = b[anchor]
                keep = is_set(likely.value, slots(bucket.view(np.int64)))
                if not keep.any():
                    continue
                first, last, anchor, bucket = first[keep], last[keep], anchor[keep], bucket[keep]
                whole = strings(deeper(b, Q, 128), length)
                shape = (anchor - first).astype(np.uint64) << np.uint64(20) | (last - first).astype(np.uint64)
                stretch = stir(stir(whole[first] * M2 + shape) + whole[last] * M1)
                yield key, *(x.astype(np.int32) for x in (first, last, anchor)), bucket.view(np.int64), stretch.view(np.int64)
        return _chunks(rows(), ["key", *RUN])

    found = staged(texts.mapInPandas(runs, RUNS), "runs")
    counts = found.groupBy("bucket", "stretch").agg(F.count("*").alias("n"))
    several = counts.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("total > 1")
    judged = found.join(counts.join(several, "bucket").select("bucket", "stretch", "n", "k"), ["bucket", "stretch"])
    settled = judged.where("n > 1").select("key", "first", "last")

    chosen = staged(judged.where("k > 1").groupBy("bucket", "stretch").agg(F.max("n").alias("n"), F.min(F.struct("key", "first", "last", "anchor")).alias("one"))
                    .select("bucket", "one.*", (F.col("n") == 1).alias("lone")), "open-runs")
    wanted = context.broadcast(bitmap(chosen, lambda f: place_slots(f.key.to_numpy(np.int64), f["first"].to_numpy()), ["key", "first"]))

    def spelled(frames):
        for frame in frames:
            for i in range(0, len(frame), 500):
                rows = []
                for key, data, b, first, last, anchor in _texts(iter([frame.iloc[i : i + 500]]), length):
                    for j in np.flatnonzero(is_set(wanted.value, place_slots(np.full(len(first), key, np.int64), first))):
                        rows.append((key, int(anchor[j]), data[first[j] : last[j] + length].tobytes()))
                yield pd.DataFrame(rows, columns=["key", "anchor", "bytes"])

    spelt = texts.mapInPandas(spelled, "key long, anchor int, bytes binary").dropDuplicates(["key", "anchor"])
    stretches = staged(chosen.join(spelt, ["key", "anchor"]), "stretches")

    def blocks(frames):
        wide = 2 * length - Q  # no stretch is longer
        for f in _slices(frames):
            b128 = deeper(padded(list(f.bytes), wide), 1, 128)
            core, cover = strings(b128, length - STEP + 1).view(np.int64), strings(b128, length + STEP - 1).view(np.int64)
            first, last, anchor = (f[c].to_numpy(np.int64) for c in ("first", "last", "anchor"))
            low, high = anchor - last, anchor - first  # offsets of the anchor in the strings of the run
            for k in range(low.min() // STEP, high.max() // STEP + 1):
                i = np.flatnonzero((low // STEP <= k) & (k <= high // STEP))
                lo, hi = np.maximum(low[i], k * STEP), np.minimum(high[i], k * STEP + STEP - 1)
                at = high[i] - k * STEP  # where the core starts in the stretch
                full = hi - lo + 1 == STEP
                whole = pd.Series(cover[i, np.where(full, at - STEP + 1, 0)], dtype="Int64").where(pd.Series(full))
                rows = f.iloc[i]
                yield pd.DataFrame({"key": rows.key.to_numpy(), "anchor": rows.anchor.to_numpy(), "bucket": rows.bucket.to_numpy(), "block": np.int32(k), "core": core[i, at],
                                    "cover": whole, "lone": rows.lone.to_numpy(), "first": (anchor[i] - hi).astype(np.int32), "last": (anchor[i] - lo).astype(np.int32)})

    block = staged(stretches.mapInPandas(blocks, "key long, anchor int, bucket long, block int, core long, cover long, lone boolean, first int, last int"), "blocks")
    same = ["bucket", "block", "core", "cover"]
    covers = block.groupBy(*same).agg(F.count("*").alias("n"), F.max("lone").alias("lone"))
    # A block that its run does not fill has no cover; such blocks are never settled here.
    cores = covers.groupBy("bucket", "block", "core").agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.max(F.col("lone") & ((F.col("n") == 1) | F.col("cover").isNull())).alias("open"),
        F.max(F.col("cover").isNull()).alias("partial")).where("total > 1")
    state = covers.join(cores, ["bucket", "block", "core"]).select(
        *[F.col(c).alias(f"s_{c}") for c in same], ((F.col("n") > 1) & F.col("cover").isNotNull()).alias("settled"),
        (F.col("open") & ((F.col("k") > 1) | F.col("partial"))).alias("mixed"))
    told = staged(block.join(state, [F.col("bucket") == F.col("s_bucket"), F.col("block") == F.col("s_block"), F.col("core") == F.col("s_core"), F.col("cover").eqNullSafe(F.col("s_cover"))])
                  .select("key", "anchor", "first", "last", "lone", "settled", "mixed"), "judged-blocks")
    by_block = told.where("settled and lone").select("key", "first", "last")

    def singles(frames):
        for f in _slices(frames):
            n = (f["last"] - f["first"] + 1).to_numpy(np.int64)
            cut = [b[i : i + k + length - 1] for b, i, k in zip(f.bytes, f["first"] - f.begin, n, strict=True)]
            ids = strings(deeper(padded(cut, length + STEP - 1), 1, 128), length).view(np.int64)
            own = np.arange(ids.shape[1]) < n[:, None]
            at = f["first"].to_numpy(np.int64)[:, None] + np.arange(ids.shape[1])
            yield pd.DataFrame({"key": np.repeat(f.key.to_numpy(), n), "at": at[own].astype(np.int32), "bucket": np.repeat(f.bucket.to_numpy(), n), "id": ids[own], "lone": np.repeat(f.lone.to_numpy(), n)})

    parts = told.where("mixed").select("key", "anchor", "first", "last", (F.col("lone") & ~F.col("settled")).alias("lone"))
    refined = staged(parts.join(stretches.select("key", "anchor", F.col("first").alias("begin"), "bucket", "bytes"), ["key", "anchor"]).select("key", "first", "last", "lone", "begin", "bucket", "bytes")
                     .mapInPandas(singles, "key long, at int, bucket long, id long, lone boolean"), "strings")
    shared = refined.groupBy("bucket", "id").agg(F.count("*").alias("n"), F.max("lone").alias("any_lone")).where("n > 1 and any_lone").select("bucket", "id")
    single = refined.where("lone").join(shared, ["bucket", "id"], "left_semi").select("key", F.col("at").alias("first"), F.col("at").alias("last"))
    return settled.unionByName(by_block).unionByName(single)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _weighed(likely, length: int):
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Size and digest of each text; the text itself only where repeated strings are likely."""
        for f in _slices(frames):
            raw = [t.encode() for t in f.text]
            need = is_set(likely.value, slots(f.key.to_numpy(np.int64))) & np.array([len(r) >= length for r in raw], bool)
            yield pd.DataFrame({"doc_id": f.doc_id.astype("Int64"), "key": f.key, "n_bytes": [len(r) for r in raw],
                                "digest": [None if x else hashlib.sha256(r).hexdigest() for r, x in zip(raw, need, strict=True)],
                                "text": [t if x else None for t, x in zip(f.text, need, strict=True)]})
    return f


def _rest(length: int):
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Bytes of a text outside its repeated strings."""
        for frame in frames:
            rows = []
            for doc_id, n, digest, text, firsts, lasts in zip(frame.doc_id.astype("Int64"), frame.n_bytes, frame.digest, frame.text, frame.firsts, frame.lasts, strict=True):
                if text is None:
                    rows.append((doc_id, n, 0, 0, digest))
                    continue
                raw = text.encode()
                mark = np.zeros(len(raw) + 1, np.int32)
                if firsts is not None:
                    np.add.at(mark, np.asarray(firsts, np.int64), 1)
                    np.subtract.at(mark, np.asarray(lasts, np.int64) + length, 1)
                gone = np.concatenate([[False], np.cumsum(mark[:-1]) > 0])
                kept = np.frombuffer(raw, np.uint8)[~gone[1:]].tobytes()
                rows.append((doc_id, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})
    return f


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text; other columns are ignored).

    A byte goes if a string of ``length`` bytes (144 to 240) that covers it starts anywhere else too. Null is the empty
    text. Every row is a document: equal rows are copies of each other; a null doc_id is a value like any other. Rows of
    one doc_id are told apart by the length and crc of their texts; together they make a 64-bit key. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", F.octet_length(text), F.crc32(text)).alias("key"))
    spans = repeated_spans(keyed.select("key", "text").where(F.octet_length("text") >= length), length)
    # At most one span for each place of a text.
    by_text = staged(spans.groupBy("key").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")), "spans")
    likely = docs.sparkSession.sparkContext.broadcast(bitmap(by_text, lambda f: slots(f.key.to_numpy(np.int64)), ["key"]))
    weighed = keyed.mapInPandas(_weighed(likely, length), "doc_id long, key long, n_bytes long, digest string, text string")
    return weighed.join(by_text, "key", "left").select("doc_id", "n_bytes", "digest", "text", "firsts", "lasts").mapInPandas(_rest(length), f"doc_id long, {RESULT}")
