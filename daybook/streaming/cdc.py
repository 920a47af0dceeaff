"""Change capture: micro-batches into the mirror, whole sync runs, and live monthly totals."""

from __future__ import annotations

from datetime import date, datetime, timezone
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.classify import resolve_flow
from .mirror import Mirror

c = F.col


def cdc_stream(source: DataFrame, mirror: Mirror, checkpoint: str, order: str = "alter_id", every: str | None = None) -> StreamingQuery:
    """Apply every micro-batch of ``source`` to the mirror (no tombstones).

    The source offsets are the cursor. The checkpoint's own id and the batch id name a batch, so one that is replayed
    after a failure overwrites its own delta, and a stream with a new checkpoint writes after what is there. Runs until
    stopped every ``every``, or once over what is there when no interval is given.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        mirror.apply(batch, batch_id, f"cdc-{batch_id}", order, writer=f"stream-{stream}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def landing_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def sync_run(spark: SparkSession, root: str, company: str, domains: dict[str, DataFrame | None], version: int, order: str = "alter_id") -> DataFrame:
    """Sync every domain (vouchers last); one log row each, and the run's own status on all of them.

    A domain that fails is recorded and does not stop the others; None means not offered (SKIPPED).
    """
    names = [d for d in domains if d != "vouchers"] + (["vouchers"] if "vouchers" in domains else [])
    run_id, rows = f"run-{version}", []
    for name in names:
        frame = domains[name]
        if frame is None:
            rows.append((run_id, company, name, "SKIPPED", 0, 0, 0, 0, None))
            continue
        try:
            s = Mirror(spark, root, name).apply(frame, version, run_id, order, full_read=True, writer="sync", company=company).first().asDict()
            rows.append((run_id, company, name, "SUCCESS", s["inserted"], s["updated"], s["unchanged"], s["tombstoned"], s["refused"]))
        except Exception as e:  # noqa: BLE001 - the run goes on with the next domain
            rows.append((run_id, company, name, "FAILED", 0, 0, 0, 0, type(e).__name__))
    done = [r for r in rows if r[3] != "SKIPPED"]
    failed = [r for r in done if r[3] == "FAILED"]
    status = "SUCCESS" if not failed else ("FAILED" if len(failed) == len(done) else "PARTIAL")
    stamp = datetime.now(timezone.utc).isoformat(timespec="seconds")
    log = spark.createDataFrame([(*r, status, stamp) for r in rows],
                                "run_id string, company_id string, domain string, status string, inserted bigint, updated bigint, unchanged bigint, "
                                "tombstoned bigint, note string, run_status string, finished_at string")
    log.write.mode("overwrite").parquet(f"{root.rstrip('/')}/_runs/version={version}")
    return log


def streaming_register(vouchers: DataFrame, types: DataFrame) -> DataFrame:
    """Month x flow totals over a voucher stream (update or complete mode; state is months x flows)."""
    live = resolve_flow(vouchers.filter(~c("is_cancelled")), types)
    return live.groupBy(F.date_trunc("month", c("voucher_date").cast("timestamp")).alias("month"), "flow").agg(
        F.count(F.lit(1)).alias("vouchers"), F.sum("amount").alias("amount"))


def streaming_daily(vouchers: DataFrame, types: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Day x flow totals for append sinks: a day is final once the watermark has passed it."""
    timed = vouchers.withColumn("ts", c("voucher_date").cast("timestamp")).withWatermark("ts", lateness)
    live = resolve_flow(timed.filter(~c("is_cancelled")), types)
    return live.groupBy(F.window("ts", "1 day"), "flow").agg(F.count(F.lit(1)).alias("vouchers"), F.sum("amount").alias("amount")).select(
        c("window.start").alias("day"), "flow", "vouchers", "amount")


REGISTER = "company_id string, month date, flow string, vouchers bigint, amount decimal(18,2)"


def _fold(key, frames, state):
    """What a voucher's newest version changes in the register: its former entry taken back, its present one added.

    The state holds the newest version seen. Versions at or below it are repeats and change nothing; of rows with one
    alter_id the greatest by its values counts, so the outcome does not depend on their order.
    """
    former = state.get if state.exists else None
    best = None
    for f in frames:
        for alter, live, month, flow, amount in zip(f.alter_id, f.is_live, f.month, f.flow, f.amount, strict=True):
            entry = (int(alter), bool(live), None if pd.isna(month) else str(month)[:10], flow if isinstance(flow, str) else None, str(amount if isinstance(amount, Decimal) else Decimal(0)))
            order = tuple((x is not None, x) for x in entry[:4]) + (Decimal(entry[4]),)
            if best is None or order > best[0]:
                best = (order, entry)
    if best is None or (former is not None and best[1][0] <= former[0]):
        return
    now = best[1]
    state.update(now)
    old = former[1:] if former is not None and former[1] else None
    new = now[1:] if now[1] else None
    if old == new:
        return
    entries = [(sign, e) for sign, e in ((-1, old), (1, new)) if e is not None]
    yield pd.DataFrame({
        "company_id": [key[0]] * len(entries), "month": [None if e[1] is None else date.fromisoformat(e[1]) for _, e in entries], "flow": [e[2] for _, e in entries],
        "vouchers": [s for s, _ in entries], "amount": [s * Decimal(e[3]) for s, e in entries]})


def register_stream(vouchers: DataFrame, types: DataFrame, root: str, every: str | None = None) -> StreamingQuery:
    """Keep the month x flow register of a stream of voucher versions right under updates, moves and deletions.

    ``vouchers``: company_id, source_object_id, alter_id, voucher_type, voucher_date, amount, is_cancelled and optionally
    is_deleted. Keyed state has the newest version of each voucher, spread over the state store's partitions; a newer one
    takes the old month's entry back. A micro-batch adds its net changes, months x flows rows, in a folder of its own, so
    a replay overwrites them. Checkpoint and register lie together under ``root``, which is one stream's. Rows without id
    or alter_id are left out; an amount that is null is 0. Runs once over what is there, or ``every`` interval.
    """
    gone = F.coalesce("is_cancelled", F.lit(False)) | (F.coalesce("is_deleted", F.lit(False)) if "is_deleted" in vouchers.columns else F.lit(False))
    versions = resolve_flow(vouchers.filter("source_object_id IS NOT NULL AND alter_id IS NOT NULL"), types).select(
        F.coalesce("company_id", F.lit("")).alias("company_id"), "source_object_id", c("alter_id").cast("bigint").alias("alter_id"), (~gone).alias("is_live"),
        F.trunc("voucher_date", "month").alias("month"), "flow", F.coalesce(c("amount").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).alias("amount"))
    changes = versions.groupBy("company_id", "source_object_id").applyInPandasWithState(
        _fold, REGISTER, "alter_id bigint, is_live boolean, month string, flow string, amount string", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        net = batch.groupBy("company_id", "month", "flow").agg(F.sum("vouchers").alias("vouchers"), F.sum("amount").cast("decimal(18,2)").alias("amount"))
        net.filter("vouchers <> 0 OR amount <> 0").write.mode("overwrite").parquet(f"{root}/register/batch={batch_id}")

    writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/_checkpoint")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def read_register(spark: SparkSession, root: str) -> DataFrame:
    """company_id, month, flow, vouchers, amount as of the batches written so far; entries with no voucher left are gone."""
    return spark.read.schema(f"{REGISTER}, batch bigint").parquet(f"{root}/register").groupBy("company_id", "month", "flow").agg(
        F.sum("vouchers").alias("vouchers"), F.sum("amount").alias("amount")).filter("vouchers <> 0")
