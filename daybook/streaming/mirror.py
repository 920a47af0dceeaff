"""The mirror: a change log per domain, read back as its latest state.

Layout: ``<root>/<domain>/kind=base|delta/version=<n>/co=<company>/bucket=<hash of the key>``. A base has one row per key,
sorted by the domain's date inside a bucket; a delta holds what one batch changed. State is the base without the keys of the
deltas after it, and the latest row of those keys, so filters on company, bucket and date reach the scan of the base.

``<root>/_commits/<domain>/epoch=<base version>`` lists what belongs to a state. A batch reserves its version there, writes its
delta and commits it: readers see committed versions only, and a replay of the same writer and batch finds its version
and overwrites it. After ``compact_every`` deltas they are folded into a new base, which begins an epoch with a list of its own,
so neither a state nor its list grows with the number of batches. Retired folders stay for the event feed and for
replays until ``vacuum``. A domain has one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.identity import content_hash
from ..session import released_shuffles

c = F.col
KEY = ["company_id", "source_object_id"]
ENVELOPE = ["content_hash", "is_deleted", "deleted_at", "synced_at", "last_run_id"]

# A pass may tombstone at most this many live rows, or this share of them.
MIN_ALLOWED, MAX_RATIO = 10, 0.15


def latest_per_key(batch: DataFrame, version: str = "alter_id") -> DataFrame:
    """The last version of every key in a batch; rows without an id are left out."""
    rest = [x for x in batch.columns if x not in KEY]
    good = batch.filter(c("source_object_id").isNotNull() & (F.length("source_object_id") > 0))
    # The row is its own order: it is shuffled once, not beside a copy to compare it by.
    last = good.groupBy(*KEY).agg(F.max(F.struct(version, *[x for x in rest if x != version])).alias("_r"))
    return last.select(*KEY, *[c(f"_r.{x}").alias(x) for x in rest])


def skipped_without_id(batch: DataFrame) -> DataFrame:
    return batch.filter(c("source_object_id").isNull() | (F.length("source_object_id") == 0))


def with_hash(batch: DataFrame) -> DataFrame:
    return batch.withColumn("content_hash", content_hash(batch, exclude=set(KEY) | set(ENVELOPE)))


def upsert_by_hash(state: DataFrame, batch: DataFrame, run_id: str, version: str = "alter_id") -> DataFrame:
    """Classified batch rows: ``change`` is INSERT, UPDATE (changed or resurrected) or UNCHANGED.

    Only key, hash and the deleted flag of the state are read for the comparison.
    """
    fresh = with_hash(latest_per_key(batch, version))
    known = state.select(c("company_id").alias("_c"), c("source_object_id").alias("_s"), c("content_hash").alias("_h"), c("is_deleted").alias("_d"))
    j = fresh.join(known, (c("company_id") == c("_c")) & (c("source_object_id") == c("_s")), "left")
    change = F.when(c("_s").isNull(), "INSERT").when((c("_h") == c("content_hash")) & ~c("_d"), "UNCHANGED").otherwise("UPDATE")
    return j.withColumn("change", change).drop("_c", "_s", "_h", "_d").withColumn("is_deleted", F.lit(False)).withColumn(
        "deleted_at", F.lit(None).cast("timestamp")).withColumn("synced_at", F.current_timestamp()).withColumn("last_run_id", F.lit(run_id))


def upsert_stats(classified: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(c("change") == x)
    return classified.agg(F.count(F.lit(1)).alias("total"), n("INSERT").alias("inserted"), n("UPDATE").alias("updated"), n("UNCHANGED").alias("unchanged"))


def _tombstones(gone: DataFrame, run_id: str) -> DataFrame:
    return gone.withColumn("change", F.lit("DELETE")).withColumn("is_deleted", F.lit(True)).withColumn("deleted_at", F.current_timestamp()).withColumn(
        "synced_at", F.current_timestamp()).withColumn("last_run_id", F.lit(run_id))


@dataclass
class Deletions:
    """``rows`` to write (none when refused), what vanished, and why nothing was written."""

    rows: DataFrame
    live: int
    vanished: int
    refused: str | None


def _guarded(live: DataFrame, gone: DataFrame, run_id: str, empty_read: bool = False) -> Deletions:
    total, missing = live.count(), gone.count()
    refused = None
    if missing and empty_read:
        refused = "EMPTY_READ"
    elif missing > max(MIN_ALLOWED, int(total * MAX_RATIO)):
        refused = "IMPLAUSIBLE_SHARE"
    rows = _tombstones(gone if refused is None else gone.limit(0), run_id)
    return Deletions(rows, total, missing, refused)


def tombstone_missing(state: DataFrame, batch: DataFrame, run_id: str) -> Deletions:
    """Live keys absent from a full read; refused as a whole when implausibly many vanished."""
    live = state.filter(~c("is_deleted"))
    return _guarded(live, live.join(batch.select(*KEY), KEY, "left_anti"), run_id)


def detect_deletions(state: DataFrame, live_keys: DataFrame, run_id: str) -> Deletions:
    """Presence by guid or by stable id; ``live_keys`` has company_id, guid, source_object_id."""
    live = state.filter(~c("is_deleted"))
    by_id = live.join(live_keys.filter(c("source_object_id").isNotNull()).select(*KEY), KEY, "left_anti")
    guids = live_keys.filter(c("guid").isNotNull()).select("company_id", "guid")
    gone = by_id.join(guids, ["company_id", "guid"], "left_anti").select(*state.columns)
    return _guarded(live, gone, run_id, empty_read=live_keys.limit(1).count() == 0)


def incremental_cursor(batch: DataFrame, checkpoint: int | Column, version: str = "alter_id") -> tuple[DataFrame, DataFrame]:
    """(rows past the checkpoint, one row with the new checkpoint). Replaying a batch yields no rows."""
    mark = checkpoint if isinstance(checkpoint, Column) else F.lit(checkpoint)
    fresh = batch.filter(c(version) > mark)
    moved = fresh.agg(F.count(F.lit(1)).alias("processed"), F.max(version).alias("top")).select(
        "processed", F.coalesce("top", mark).cast("bigint").alias("checkpoint"))
    return fresh, moved


def change_events(*changes: DataFrame) -> DataFrame:
    """INSERT / UPDATE / DELETE feed of classified rows."""
    out = None
    for d in changes:
        rows = d.filter(c("change").isin("INSERT", "UPDATE", "DELETE")).select(*KEY, "change", "content_hash")
        out = rows if out is None else out.unionByName(rows)
    return out


COMMIT = "writer string, batch bigint, version bigint, kind string"
PLACE = ["kind", "version", "co", "bucket"]


class Mirror:
    """One domain's change log under a shared folder."""

    def __init__(self, spark: SparkSession, root: str, domain: str, buckets: int = 16, compact_every: int = 20, sort_by: str = "voucher_date"):
        self.spark, self.root, self.domain = spark, root.rstrip("/"), domain
        self.path, self.commits = f"{self.root}/{domain}", f"{self.root}/_commits/{domain}"
        self.buckets, self.compact_every, self.sort_by = buckets, compact_every, sort_by

    # --- commits ---------------------------------------------------------------------------

    def _names(self, path: str) -> list[str]:
        """Names in a folder of any file system that the cluster reads."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _epochs(self) -> list[int]:
        found = sorted(int(n.split("=")[1]) for n in self._names(self.commits) if n.startswith("epoch="))
        return [e for e in found if "_SUCCESS" in self._names(f"{self.commits}/epoch={e}")]

    def _listed(self, before: int | None = None) -> list:
        """Commits of the newest epoch, or of the one that a state ``before`` a version belongs to; a few rows per batch since its base."""
        epochs = [e for e in self._epochs() if before is None or e < before]
        if not epochs:
            return []
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.commits}/epoch={epochs[-1]}").distinct().collect()
        return [r for r in rows if before is None or r["version"] < before]

    def _commit(self, writer: str, batch: int, version: int, kind: str) -> None:
        epoch = max((e for e in self._epochs()), default=-1)
        self.spark.createDataFrame([(writer, batch, version, kind)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.commits}/epoch={epoch}")

    def version_of(self, batch: int, writer: str) -> int:
        """The version of a batch: the one it had before, else one after all others (its own number where that is free)."""
        listed = self._listed()
        of_writer = [r for r in listed if r["writer"] == writer and r["batch"] is not None]
        known = [r["version"] for r in of_writer if r["batch"] == batch]
        if not known and any(r["batch"] > batch for r in of_writer):
            # An older batch than the last one of this writer: its commit may be in an epoch before.
            old = self.spark.read.schema(COMMIT).parquet(*[f"{self.commits}/epoch={e}" for e in self._epochs()])
            known = [r[0] for r in old.filter((c("writer") == writer) & (c("batch") == batch)).select("version").distinct().collect()]
        if known:
            return max(known)
        last = max((r["version"] for r in listed), default=None)
        version = batch if last is None else max(batch, last + 1)
        self._commit(writer, batch, version, "reserved")
        return version

    # --- reading ---------------------------------------------------------------------------

    def _rows(self, kind: str, versions: list[int]) -> DataFrame | None:
        if not versions:
            return None
        paths = [f"{self.path}/kind={kind}/version={v}" for v in sorted(versions)]
        return self.spark.read.option("basePath", self.path).option("mergeSchema", True).parquet(*paths)

    def _parts(self, before: int | None = None) -> tuple[DataFrame | None, DataFrame | None, bool]:
        """(newest base, committed deltas after it, whether they are a single one)."""
        listed = self._listed(before)
        base = max((r["version"] for r in listed if r["kind"] == "base"), default=None)
        deltas = {r["version"] for r in listed if r["kind"] == "delta" and (base is None or r["version"] > base)}
        return self._rows("base", [] if base is None else [base]), self._rows("delta", list(deltas)), len(deltas) == 1

    @staticmethod
    def _folded(base: DataFrame | None, deltas: DataFrame | None, where: Column | None = None, single: bool = False) -> DataFrame | None:
        """One row per key. ``where`` is for rows of the base and for the latest of a key in the deltas, never for older ones; ``single``: they are one delta."""
        keep = lambda df: df.drop(*PLACE) if where is None else df.filter(where).drop(*PLACE)
        if deltas is None:
            return None if base is None else keep(base)
        rest = [x for x in deltas.columns if x not in [*KEY, *PLACE]]
        # A key's history is folded by aggregation, so a hot key is not gathered in one task. One delta has one row per key as it is.
        latest = deltas if single else deltas.groupBy(*KEY).agg(F.max_by(F.struct(*rest), c("version")).alias("_r")).select(*KEY, "_r.*")
        if base is None:
            return keep(latest)
        changed = deltas.select(c("company_id").alias("_c"), c("source_object_id").alias("_s")).distinct()
        old = keep(base).join(changed, c("company_id").eqNullSafe(c("_c")) & (c("source_object_id") == c("_s")), "left_anti")
        return old.unionByName(keep(latest), allowMissingColumns=True)

    def state(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """Latest row per key, tombstones included, as it was ``before`` a version; of some key buckets only, if given. None while there is nothing."""
        pruned = lambda df: df if df is None or buckets is None else df.filter(c("bucket").isin(buckets))
        base, deltas, single = self._parts(before)
        return self._folded(pruned(base), pruned(deltas), single=single)

    def read(self, company: str, where: Column | None = None) -> DataFrame | None:
        """Live rows of a company, with a condition on their columns that reaches the scan of the base."""
        own = lambda df: None if df is None else df.filter((c("co") == f"c-{company}") & (c("company_id") == company))
        base, deltas, single = self._parts()
        live = ~c("is_deleted") if where is None else ~c("is_deleted") & where
        return self._folded(own(base), own(deltas), live, single)

    def events(self) -> DataFrame | None:
        """The feed: every change of every committed delta that was not vacuumed."""
        try:
            rows = self.spark.read.option("basePath", self.path).option("mergeSchema", True).parquet(f"{self.path}/kind=delta")
        except AnalysisException:
            return None
        return rows.filter(c("change").isin("INSERT", "UPDATE", "DELETE")).select(*KEY, "change", "content_hash", "version")

    # --- writing ---------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("source_object_id"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        placed = rows.withColumn("co", F.concat(F.lit("c-"), c("company_id"))).withColumn("bucket", self.bucket())
        order = ["co", "bucket", *([self.sort_by] if self.sort_by in rows.columns else [])]
        placed.repartition("co", "bucket").sortWithinPartitions(*order).write.partitionBy("co", "bucket").mode("overwrite").parquet(f"{self.path}/kind={kind}/version={version}")

    def compact(self, version: int) -> None:
        """Fold everything up to ``version`` into a new base and begin its epoch, with each writer's last batch and all later commits."""
        listed = self._listed()
        base = max((r["version"] for r in listed if r["kind"] == "base"), default=-1)
        state = self.state(version + 1) if version > base else None
        if state is None:
            return
        with released_shuffles(state.sparkSession):
            self._write(state, "base", version)
        last = {}
        for r in listed:
            if r["batch"] is not None and (r["writer"] not in last or r["batch"] > last[r["writer"]]["batch"]):
                last[r["writer"]] = r
        kept = {(None, None, version, "base"), *[(w, r["batch"], r["version"], "reserved") for w, r in last.items()], *[tuple(r) for r in listed if r["version"] > version]}
        self.spark.createDataFrame(sorted(kept, key=str), COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.commits}/epoch={version}")

    def vacuum(self, before: int) -> list[str]:
        """Delete folders of versions ``before`` one that no state of the newest epoch reads, and epochs before it. Returns what went."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        listed, epochs = self._listed(), self._epochs()
        base = max((r["version"] for r in listed if r["kind"] == "base"), default=None)
        if base is None:
            return []
        old = [f"{self.path}/kind={k}/{n}" for k in ("base", "delta") for n in self._names(f"{self.path}/kind={k}")
               if n.startswith("version=") and int(n.split("=")[1]) < before and (int(n.split("=")[1]) < base or (k == "delta" and int(n.split("=")[1]) == base))]
        old += [f"{self.commits}/epoch={e}" for e in epochs[:-1] if e < before]
        for path in old:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        return old

    def apply(self, batch: DataFrame, number: int, run_id: str, order: str = "alter_id", full_read: bool = False, writer: str = "", company: str | None = None) -> DataFrame:
        """Upsert batch ``number`` of a writer (and, after a full read, tombstone what vanished). Returns the stats row.

        Only the key buckets of the batch are read, after a full read all of them; of ``company`` alone, if the full read was
        of one. A replay is classified against the state that the batch met the first time, whatever was written or
        compacted since.
        """
        version = self.version_of(number, writer)
        good = batch.filter(c("source_object_id").isNotNull() & (F.length("source_object_id") > 0))
        touched = None if full_read else [r[0] for r in good.select(self.bucket()).distinct().collect()]  # at most ``buckets`` numbers
        state = self.state(version, touched)
        if state is None:
            fresh = with_hash(latest_per_key(batch, order))
            classified = fresh.withColumn("change", F.lit("INSERT")).withColumn("is_deleted", F.lit(False)).withColumn(
                "deleted_at", F.lit(None).cast("timestamp")).withColumn("synced_at", F.current_timestamp()).withColumn("last_run_id", F.lit(run_id))
        else:
            classified = upsert_by_hash(state, batch, run_id, order)
        rows = classified.filter(c("change") != "UNCHANGED")
        tombstoned, refused = 0, None
        # Nothing is kept: what a batch shuffles goes when its delta is written, and the delta says what it changed.
        with released_shuffles(batch.sparkSession):
            if full_read and state is not None:
                gone = tombstone_missing(state if company is None else state.filter(c("company_id") == company), batch, run_id)
                tombstoned, refused = (0 if gone.refused else gone.vanished), gone.refused
                rows = rows.unionByName(gone.rows, allowMissingColumns=True)
            self._write(rows, "delta", version)
            skipped = skipped_without_id(batch).count()
            total = None if state is None else good.select(*KEY).distinct().count()
        # A batch that changed nothing has no files; it is committed, but no state reads it.
        filled = any(n.startswith("co=") for n in self._names(f"{self.path}/kind=delta/version={version}"))
        _, inserted, updated, _ = upsert_stats(self._rows("delta", [version])).first() if filled else (0, 0, 0, 0)
        stats = (inserted, inserted, 0, 0) if total is None else (total, inserted, updated, total - inserted - updated)
        self._commit(writer, number, version, "delta" if filled else "empty")
        if len({r["version"] for r in self._listed() if r["kind"] in ("delta", "empty")}) >= self.compact_every:
            self.compact(version)
        return self.spark.createDataFrame([(*stats, skipped, tombstoned, refused)],
                                          "total bigint, inserted bigint, updated bigint, unchanged bigint, skipped bigint, tombstoned bigint, refused string")


def scan_mirror_vouchers(mirror: Mirror, company: str, start=None, end=None) -> DataFrame:
    """Live vouchers of a company in a date range; company and dates reach the scan."""
    when = F.lit(True)
    if start is not None:
        when = when & (c("voucher_date") >= F.lit(start))
    if end is not None:
        when = when & (c("voucher_date") <= F.lit(end))
    return mirror.read(company, when)


def scan_mirror_domain(mirror: Mirror, company: str) -> DataFrame:
    return mirror.read(company)


def domain_counts(domains: dict[str, DataFrame]) -> DataFrame:
    """Rows per domain of what was read of each."""
    out = None
    for name, live in domains.items():
        rows = live.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("domain"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out
