"""The register under updates, moved dates, cancellations and deletions, over micro-batches and a restart."""

from datetime import date
from decimal import Decimal

from daybook.streaming import cdc

SCHEMA = "company_id string, source_object_id string, alter_id bigint, voucher_type string, voucher_date date, amount decimal(18,2), is_cancelled boolean, is_deleted boolean"


def version(key, alter, month, amount, cancelled=False, deleted=False, company="A", kind="Sales"):
    return (company, key, alter, kind, month and date(2024, month, 10), None if amount is None else Decimal(amount), cancelled, deleted)


def test_entries_are_taken_back(spark, tmp_path):
    root = str(tmp_path)
    types = spark.createDataFrame([("Sales", "Sales"), ("Purchase", "Purchase")], "name string, parent string")

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        cdc.register_stream(source, types, root).awaitTermination()
        return {(r.company_id, r.month and r.month.month, r.flow): (r.vouchers, float(r.amount)) for r in cdc.read_register(spark, root).collect()}

    assert feed([version("1", 1, 1, "10"), version("2", 1, 1, "5"), version("3", 2, 2, "7"), version("1", 1, 1, "10", company="B"), version(None, 1, 1, "99")]) == {
        ("A", 1, "SALES"): (2, 15), ("A", 2, "SALES"): (1, 7), ("B", 1, "SALES"): (1, 10)}
    # A changed amount and a moved date in one batch, of which only the newest version counts; an old version comes late.
    assert feed([version("1", 2, 1, "11"), version("1", 3, 3, "12"), version("3", 1, 1, "70")]) == {
        ("A", 1, "SALES"): (1, 5), ("A", 2, "SALES"): (1, 7), ("A", 3, "SALES"): (1, 12), ("B", 1, "SALES"): (1, 10)}
    # Deleted, cancelled, of another flow; a repeat changes nothing.
    assert feed([version("3", 3, 2, "7", deleted=True), version("2", 2, 1, "5", cancelled=True), version("1", 4, 3, "12", kind="Purchase"), version("1", 1, 1, "10", company="B")]) == {
        ("A", 3, "PURCHASE"): (1, 12), ("B", 1, "SALES"): (1, 10)}
    # One that was deleted comes back; a null date is a month of its own, a null amount 0.
    assert feed([version("3", 4, 2, "8"), version("9", 1, None, None)]) == {
        ("A", 2, "SALES"): (1, 8), ("A", 3, "PURCHASE"): (1, 12), ("A", None, "SALES"): (1, 0), ("B", 1, "SALES"): (1, 10)}
