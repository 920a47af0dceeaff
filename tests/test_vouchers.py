"""Raw vouchers from files through normalisation to facts."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from daybook.operators import fact as ft
from daybook.sources import export_xml, normalize, typed_json

XML = """<ENVELOPE><BODY><DATA><COLLECTION>
<VOUCHER><GUID>vch-1001</GUID><VOUCHERNUMBER>1001</VOUCHERNUMBER><VOUCHERTYPENAME>Sales</VOUCHERTYPENAME><DATE>20230715</DATE>
<PARTYLEDGERNAME>Acme Traders</PARTYLEDGERNAME><AMOUNT>15000</AMOUNT>
<ALLLEDGERENTRIES.LIST><LEDGERNAME>Acme Traders</LEDGERNAME><AMOUNT>15000</AMOUNT></ALLLEDGERENTRIES.LIST>
<ALLLEDGERENTRIES.LIST><LEDGERNAME>Output IGST</LEDGERNAME><AMOUNT>-3000</AMOUNT></ALLLEDGERENTRIES.LIST>
<ALLLEDGERENTRIES.LIST><LEDGERNAME>Sales Account</LEDGERNAME><AMOUNT>-12000</AMOUNT>
 <CATEGORYALLOCATIONS.LIST><CATEGORY>Primary</CATEGORY><COSTCENTREALLOCATIONS.LIST><NAME>Ravi</NAME><AMOUNT>-12000</AMOUNT></COSTCENTREALLOCATIONS.LIST></CATEGORYALLOCATIONS.LIST>
</ALLLEDGERENTRIES.LIST>
<ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>Steel Rod</STOCKITEMNAME><BILLEDQTY>10 Nos</BILLEDQTY><RATE>1000/Nos</RATE><AMOUNT>-10000</AMOUNT></ALLINVENTORYENTRIES.LIST>
<ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>Wire</STOCKITEMNAME><BILLEDQTY> 4 Kg</BILLEDQTY><RATE>500/Kg</RATE><AMOUNT>-2000</AMOUNT></ALLINVENTORYENTRIES.LIST>
</VOUCHER></COLLECTION></DATA></BODY></ENVELOPE>"""


def test_xml_to_facts(spark, tmp_path):
    (tmp_path / "ok.xml").write_text(XML)
    records, rejects = export_xml.read_vouchers_xml(spark, str(tmp_path / "ok.xml"))
    assert rejects.count() == 0
    vouchers, stock, ledger = normalize.voucher_tables(normalize.normalize_sales_vouchers(records, "CO1"))
    v = vouchers.first()
    assert (v["voucher_id"], str(v["voucher_date"]), v["amount"]) == ("vch-1001", "2023-07-15", Decimal("15000.00"))
    lines = {r["item"]: r for r in stock.collect()}
    assert lines["Steel Rod"]["unit"] == "Nos" and lines["Wire"]["quantity"] == Decimal("4.000")
    assert lines["Steel Rod"]["amount"] == Decimal("10000.00") and lines["Steel Rod"]["is_credit"]
    ledgers = spark.createDataFrame([("CO1", "L1", " acme  TRADERS", "Sundry Debtors", "India", "Gujarat", ["12 Mill Rd", "Surat - 395003"], None)],
                                    "company_id string, source_object_id string, name string, parent string, country string, state string, address_lines array<string>, closing_balance decimal(18,2)")
    items = spark.createDataFrame([("CO1", "I1", "steel rod", "Metals")], "company_id string, source_object_id string, name string, parent string")
    groups = spark.createDataFrame([("CO1", "G1", "Metals", "Primary")], "company_id string, source_object_id string, name string, parent string")
    centres = spark.createDataFrame([("CO1", "C1", "RAVI")], "company_id string, source_object_id string, name string")
    classes = spark.createDataFrame([("CO1", "L1", "A", "Dealer", "guess", "2024"), ("CO1", "L1", "B", None, "manual", "2024")],
                                    "company_id string, ledger_id string, tier string, customer_type string, source string, updated_at string")
    types = spark.createDataFrame([("Sales", "Sales")], "name string, parent string")
    rows = {r["item"]: r for r in ft.build_fact_sales(vouchers, stock, ledger, ledgers, items, groups, centres, classes, types).collect()}
    rod = rows["steel rod"]
    assert not rod["is_return"], "a sale posted on the credit side is still a sale"
    assert (rod["city"], rod["grp"], rod["salesman"], rod["tier"]) == ("Surat", "Metals", "RAVI", "B")
    assert rod["amount_with_charges"] == Decimal("12500.00")
    assert rod["data_quality"] == ["CUSTOMER_TYPE_NOT_CONFIGURED"]
    assert "STOCK_ITEM_NOT_FOUND" in rows["Wire"]["data_quality"]
    assert sum(r["amount_with_charges"] for r in rows.values()) == Decimal("15000.00")


def test_a_voucher_that_comes_twice_gives_its_rows_once(spark):
    voucher = lambda n, amount, cancelled=False: ("CO1", "v1", n, "Sales", "2024-01-05", "Acme", Decimal(amount), cancelled, False)
    vouchers = "company_id string, voucher_id string, voucher_number string, voucher_type string, voucher_date string, party string, amount decimal(18,2), is_cancelled boolean, is_optional boolean"
    stock = "company_id string, voucher_id string, entry_id string, line bigint, item string, quantity decimal(18,3), unit string, rate string, amount decimal(18,2), is_credit boolean, cost_centre string"
    ledger = "company_id string, voucher_id string, line bigint, ledger string, amount decimal(18,2), is_credit boolean, cost_centre string"
    line = lambda co, v, e, item, amount: (co, v, e, 1, item, Decimal(1), "Nos", "1", Decimal(amount), True, None)
    tax = lambda co, v, amount: (co, v, 1, "Output IGST", Decimal(amount), True, None)
    none = {"ledgers": "company_id string, source_object_id string, name string, parent string, country string, state string, address_lines array<string>, closing_balance decimal(18,2)",
            "items": "company_id string, source_object_id string, name string, parent string", "groups": "company_id string, source_object_id string, name string, parent string",
            "centres": "company_id string, source_object_id string, name string", "classes": "company_id string, ledger_id string, tier string, customer_type string, source string, updated_at string"}
    masters = [spark.createDataFrame([], x) for x in none.values()]
    types = spark.createDataFrame([("Sales", "Sales")], "name string, parent string")

    def build(v, s, l, arrivals=None):
        frames = [spark.createDataFrame(rows, schema) for rows, schema in ((v, vouchers), (s, stock), (l, ledger))]
        if arrivals:
            frames = [spark.createDataFrame([(*r, n) for r, n in zip(rows, arrivals[i])], schema + ", arrival int") for i, (rows, schema) in enumerate(((v, vouchers), (s, stock), (l, ledger)))]
        b = ft.build_facts(*frames, *masters, types)
        return sorted((r["company_id"], r["entry_id"], r["item"], float(r["amount_with_charges"])) for r in b.facts.collect()), sorted((r["voucher_id"], r["reason"], r["copies"]) for r in b.rejected.collect())

    lines, taxes = [line("CO1", "v1", "e1", "Rod", 60), line("CO1", "v1", "e2", "Wire", 40)], [tax("CO1", "v1", 10)]
    once = build([voucher("1", 110)], lines, taxes)
    assert once == ([("CO1", "e1", "Rod", 66.0), ("CO1", "e2", "Wire", 44.0)], [])
    assert build([voucher("1", 110)] * 3, lines * 3, taxes * 3) == (once[0], [("v1", "DUPLICATE_ROW_ID", 2)] * 2)
    later = [line("CO1", "v1", "e1", "Aaa", 1), line("CO1", "v1", "e2", "Bbb", 1)]
    assert build([voucher("1", 110), voucher("0", 9)], lines + later, taxes + [tax("CO1", "v1", 99)], [[1, 2], [1, 1, 2, 2], [1, 2]]) == (once[0], [("v1", "DUPLICATE_ROW_ID", 1)] * 2)
    other = [("CO2", *voucher("1", 110)[1:])]
    both = build([voucher("1", 110), *other], lines + [("CO2", *x[1:]) for x in lines], taxes + [("CO2", *x[1:]) for x in taxes])
    assert len(both[0]) == 4 and both[1] == [], "the same ids in another company are other rows"
    service = build([voucher("1", 110)] * 2, [], [])
    assert [x[1] for x in service[0]] == ["v1#ACCT1"] and service[1] == [("v1", "DUPLICATE_ROW_ID", 1)]


def test_bad_responses_are_reported(spark, tmp_path):
    for name, text in {"a": "", "b": "<ENVELOPE><LINEERROR>no company</LINEERROR></ENVELOPE>", "c": "<HTML/>", "d": XML}.items():
        (tmp_path / f"{name}.xml").write_text(text or "\n")
    got = {r["file"].rsplit("/", 1)[1]: r["problem"] for r in export_xml.response_problems(spark, str(tmp_path)).collect()}
    assert got == {"a.xml": "EMPTY", "b.xml": "LINE_ERROR", "c.xml": "NO_ENVELOPE"}


def test_typed_json_file(spark, tmp_path):
    t = lambda kind, value: {"type": kind, "value": value}
    doc = {"collection": [{"metadata": {"type": "Ledger", "name": "Acme"}, "guid": t("String", " g-1 "), "openingbalance": t("Amount", "-12.50"), "isbillwiseon": t("Logical", "Yes"),
                           "openedon": t("Date", "20240401")}, {"metadata": {"type": "Ledger", "name": "Zed", "masterId": "7"}, "openingbalance": t("Amount", "oops")}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    fields = {"guid": "string", "openingbalance": "number", "isbillwiseon": "boolean", "openedon": "date"}
    rows = typed_json.read_typed_json(spark, str(tmp_path), fields, "CO1").orderBy("name").collect()
    assert (rows[0]["source_object_id"], rows[0]["openingbalance"], rows[0]["isbillwiseon"], str(rows[0]["openedon"])) == ("g-1", Decimal("-12.500"), True, "2024-04-01")
    assert rows[1]["source_object_id"] == "MID_7" and rows[1]["openingbalance"] is None


def test_statement_json_file(spark, tmp_path):
    detail = lambda n, a: {"bsname": {"dspaccname": {"dspdispname": n}}, "bsamt": [{"bsmainamt": a}]}
    doc = {"data": {"bsbody": {"bsinfo": {"bssources": {"bsdetail": [detail("Capital", "100.5")]}, "bsapplications": {"bsdetail": [detail("Cash", "40")]}}},
                    "plbody": {"Sales": {"type": "Amount", "value": "9.25"}}}}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    got = {(r["report"], r["side"], r["name"], float(r["amount"])) for r in typed_json.read_statement_json(spark, str(tmp_path)).collect()}
    assert got == {("Balance Sheet", "sources", "Capital", 100.5), ("Balance Sheet", "applications", "Cash", 40.0), ("Profit and Loss", "details", "Sales", 9.25)}


def test_amount_texts(spark):
    from daybook.functions.identity import signed_text_amount

    cases = {"1,200 Cr": -1200, "-500": -500, "300 Dr": 300, "$10 @ 80 = 800.55": 800.55, "": 0, "abc": 0, "2.5 CR": -2.5}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", signed_text_amount(F.col("t")).alias("v"))
    assert {r["t"]: float(r["v"]) for r in df.collect()} == cases


def test_city_parser(spark):
    from daybook.functions.places import parse_cities

    cases = [(["Shop 4", "Ring Road, Surat - 395003", "Gujarat"], "Gujarat", "Surat", "high"), (["Mill Area", "Pune", "India"], None, "Pune", "medium"),
             (["PO Box 9", "99887766"], None, None, "none"), ([], None, None, "none"), (["Main St, Jaipur, Rajasthan"], "Rajasthan", "Jaipur", "low")]
    df = spark.createDataFrame([(i, a, s) for i, (a, s, _, _) in enumerate(cases)], "i int, address_lines array<string>, state string")
    got = parse_cities(df).orderBy("i").collect()
    assert [(r["city"], r["city_confidence"]) for r in got] == [(x, y) for _, _, x, y in cases]


def test_round_off_is_signed_by_its_side_against_the_party(spark):
    from daybook.operators import fact as ft
    from daybook.operators.register import voucher_ledger_breakdown

    def lines(voucher, party_credit, *rounds):
        yield ("CO1", voucher, "Acme", "Acme", 100.0, party_credit)
        for amount, credit in rounds:
            yield ("CO1", voucher, "Acme", "Round Off", amount, credit)

    rows = [*lines("sale_up", False, (0.4, True)), *lines("sale_down", False, (0.3, False)), *lines("buy_up", True, (0.2, False)),
            *lines("buy_down", True, (0.1, True)), *lines("both", False, (0.5, True), (0.2, False)), *lines("none", True),
            ("CO1", "no_party", "Acme", "Rounding", 0.6, False), ("CO1", "no_side", "Acme", "Rounding", 0.7, None)]
    raw = spark.createDataFrame(rows, "company_id string, voucher_id string, party string, ledger string, amount double, is_credit boolean")
    roled = ft.classify_ledger_role(raw.withColumn("amount", F.col("amount").cast("decimal(18,2)")))
    want = {"sale_up": 0.4, "sale_down": -0.3, "buy_up": 0.2, "buy_down": -0.1, "both": 0.3, "none": 0.0, "no_party": -0.6, "no_side": 0.7}
    for out in (ft.voucher_charges(roled), voucher_ledger_breakdown(roled)):
        assert {r["voucher_id"]: float(r["round_off"]) for r in out.collect()} == want
