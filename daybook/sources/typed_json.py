"""Typed JSON exports: every field is {"type": ..., "value": ...}; and statement reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import parse_date, stable_id

TAGGED = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
META = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "name", "guid", "masterId")])

# Type tags of each kind of value.
TAGS = {"number": ("amount", "number", "quantity"), "boolean": ("logical", "boolean"), "date": ("date",)}


def typed_value(field: Column, kind: str) -> Column:
    """The value as its kind when the tag says so (untagged text is trimmed); NULL when it does not parse."""
    tag, value = F.lower(field["type"]), F.trim(field["value"])
    if kind == "number":
        return F.when(tag.isin(*TAGS["number"]), value.try_cast("decimal(18,3)"))
    if kind == "boolean":
        return F.when(tag.isin(*TAGS["boolean"]), value.isin("Yes", "True", "true", "1"))
    if kind == "date":
        return F.when(tag.isin(*TAGS["date"]), parse_date(value))
    return value


def collection_schema(fields: dict[str, str]) -> T.StructType:
    item = T.StructType([T.StructField("metadata", META), *[T.StructField(f, TAGGED) for f in fields]])
    return T.StructType([T.StructField("collection", T.ArrayType(item)),
                         T.StructField("data", T.StructType([T.StructField("collection", T.ArrayType(item))]))])


def flatten_collection(docs: DataFrame, fields: dict[str, str], company_id: str) -> DataFrame:
    """One flat row per collection object, columns typed by ``fields`` (name -> number|boolean|date|string)."""
    items = docs.select(F.explode(F.coalesce(F.col("collection"), F.col("data.collection"))).alias("o"))
    known = {f: typed_value(F.col(f"o.{f}"), kind).alias(f) for f, kind in fields.items()}
    tag = lambda n: F.col(f"o.{n}.value") if n in fields else F.lit(None).cast("string")
    name = F.trim(F.coalesce(F.col("o.metadata.name"), tag("name")))
    guid = F.coalesce(tag("guid"), F.col("o.metadata.guid"))
    master = F.coalesce(tag("masterid"), F.col("o.metadata.masterId"))
    fallback = F.concat(F.lit("NAME_"), name)
    ident = F.when(F.length(F.trim(F.coalesce(guid, master, F.lit("")))) > 0, stable_id(guid, master, F.lit(None).cast("string"))).otherwise(fallback)
    rest = [x for n, x in known.items() if n not in ("name", "guid")]
    return items.select(F.lit(company_id).alias("company_id"), ident.alias("source_object_id"), F.coalesce(F.col("o.metadata.type"), F.lit("Master")).alias("object_type"),
                        name.alias("name"), *rest)


def read_typed_json(spark: SparkSession, path: str, fields: dict[str, str], company_id: str) -> DataFrame:
    docs = spark.read.schema(collection_schema(fields)).option("multiLine", True).json(path)
    return flatten_collection(docs, fields, company_id)


def parse_typed_json(df: DataFrame, col: str, fields: dict[str, str], company_id: str) -> DataFrame:
    """The same for documents in a string column."""
    return flatten_collection(df.select(F.from_json(F.col(col), collection_schema(fields)).alias("d")).select("d.*"), fields, company_id)


_DETAIL = ("array<struct<bsname:struct<dspaccname:struct<dspdispname:string>>,name:string,"
           "bsamt:array<struct<bsmainamt:string>>,amount:string>>")
STATEMENT = (f"struct<bsbody:struct<bsinfo:struct<bssources:struct<bsdetail:{_DETAIL}>,bsapplications:struct<bsdetail:{_DETAIL}>>>,"
             "plbody:map<string,struct<type:string,value:string>>>")


def flatten_statements(docs: DataFrame) -> DataFrame:
    """report, side, name, amount of balance-sheet details and of profit-and-loss entries."""
    d = docs.select(F.coalesce(F.col("data"), F.struct(F.col("bsbody"), F.col("plbody"))).alias("d"))

    def side(which: str) -> DataFrame:
        rows = d.select(F.explode(F.col(f"d.bsbody.bsinfo.bs{which}.bsdetail")).alias("r"))
        amount = F.coalesce(F.get(F.col("r.bsamt"), 0)["bsmainamt"], F.col("r.amount")).try_cast("decimal(18,2)")
        return rows.select(F.lit("Balance Sheet").alias("report"), F.lit(which).alias("side"),
                           F.coalesce("r.bsname.dspaccname.dspdispname", "r.name", F.lit("Unknown")).alias("name"), F.coalesce(amount, F.lit(0)).alias("amount"))

    pl = d.select(F.explode("d.plbody").alias("name", "v")).select(
        F.lit("Profit and Loss").alias("report"), F.lit("details").alias("side"), "name", F.coalesce(F.col("v.value").try_cast("decimal(18,2)"), F.lit(0)).alias("amount"))
    return side("sources").unionByName(side("applications")).unionByName(pl)


def read_statement_json(spark: SparkSession, path: str) -> DataFrame:
    body = T._parse_datatype_string(STATEMENT)
    schema = T.StructType([T.StructField("data", body), *body.fields])
    return flatten_statements(spark.read.schema(schema).option("multiLine", True).json(path))


def parse_statement_json(df: DataFrame, col: str) -> DataFrame:
    body = T._parse_datatype_string(STATEMENT)
    schema = T.StructType([T.StructField("data", body), *body.fields])
    return flatten_statements(df.select(F.from_json(F.col(col), schema).alias("d")).select("d.*"))
