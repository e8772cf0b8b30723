"""The register's XML records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = "BusinessAddress: struct<AddressDetails: struct<State: string, Postcode: string>>, MainBusinessPhysicalAddress: struct<StateCode: string, Postcode: string, AddressLine: string>"
#: One record. Addresses may stand under MainEntity or right under the record.
RECORD = (
    "ABN struct<_VALUE: string, _status: string>, EntityType struct<EntityTypeText: string>, "
    "LegalEntity struct<IndividualName: struct<GivenName: array<string>, FamilyName: string>>, "
    f"MainEntity struct<NonIndividualName: struct<NonIndividualNameText: string>, {_PLACE}>, "
    "BusinessAddress struct<AddressDetails: struct<State: string, Postcode: string>>, "
    "MainBusinessPhysicalAddress struct<StateCode: string, Postcode: string, AddressLine: string>, "
    "EntityStatus struct<EffectiveFrom: string>, EntityName string, MainName string, LegalName string, ABNStatusFromDate string"
)


def read_register(spark: SparkSession, path: str, tag: str = "ABR") -> DataFrame:
    """Records of all .xml files of a folder; files or records that don't parse are left out."""
    raw = spark.read.format("xml").schema(f"{RECORD}, _broken string").options(rowTag=tag, pathGlobFilter="*.xml", mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", inferSchema="false").load(path)
    return raw.filter("_broken is null").drop("_broken")


def parse_record(xml: Column) -> Column:
    return F.from_xml(xml, RECORD)


def _or_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def _row_columns(prefix: str) -> list[Column]:
    """The eight columns of a raw register row. An individual's name wins wherever that element exists, and so does a
    non-individual's next, even if empty; then the first of three plain names that isn't."""
    c = lambda name: F.col(f"{prefix}{name}")
    person = c("LegalEntity.IndividualName")
    names = F.array_append(F.coalesce(person["GivenName"], F.array().cast("array<string>")), person["FamilyName"])
    full = F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), " ")
    firm = c("MainEntity.NonIndividualName")
    plain = _or_empty(c("EntityName"), c("MainName"), c("LegalName"))
    name = F.when(person.isNotNull(), full).when(firm.isNotNull(), F.coalesce(firm["NonIndividualNameText"], F.lit(""))).otherwise(plain)
    near = F.coalesce(c("MainEntity.BusinessAddress.AddressDetails"), c("BusinessAddress.AddressDetails"))
    main = F.coalesce(c("MainEntity.MainBusinessPhysicalAddress"), c("MainBusinessPhysicalAddress"))
    state = F.coalesce(F.when(near.isNotNull(), near["State"]).otherwise(main["StateCode"]), F.lit(""))
    postcode = F.coalesce(F.when(near.isNotNull(), near["Postcode"]).otherwise(main["Postcode"]), F.lit(""))
    return [
        _or_empty(c("ABN._VALUE")).alias("abn"), name.alias("entity_name"), _or_empty(c("EntityType.EntityTypeText")).alias("entity_type"),
        _or_empty(c("ABN._status")).alias("entity_status"), F.trim(F.concat_ws(" ", state, postcode)).alias("address"), postcode.alias("postcode"), state.alias("state"),
        _or_empty(c("ABNStatusFromDate"), c("EntityStatus.EffectiveFrom")).alias("start_date"),
    ]


def register_row(df: DataFrame, prefix: str = "") -> DataFrame:
    """The eight columns of raw register rows."""
    return df.select(*_row_columns(prefix))


def register_row_with_line(df: DataFrame, prefix: str = "") -> DataFrame:
    """register_row with the line of the main address, '' without one, as the address."""
    c = lambda name: F.col(f"{prefix}{name}")
    line = _or_empty(c("MainEntity.MainBusinessPhysicalAddress.AddressLine"), c("MainBusinessPhysicalAddress.AddressLine"))
    cols = _row_columns(prefix)
    return df.select(*cols[:4], line.alias("address"), *cols[5:])
