"""Adviser extracts and ZIP gazetteers -> dimensions."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: accepted spellings of the identity columns after lower-casing and dropping punctuation
HEADERS = {
    "crd": ("organizationcrd#", "organizationcrd", "crd#", "crdnumber", "firmcrd#", "crd"),
    "sec_number": ("sec#", "secnumber", "secfile#", "secregistration#", "secfilenumber"),
    "legal_name": ("legalname", "fulllegalname", "1alegalname"),
    "business_name": ("primarybusinessname", "businessname", "1bprimarybusinessname", "1b1name"),
    "city": ("mainofficecity", "1fmainofficecity", "city"),
    "state": ("mainofficestate", "1fmainofficestate", "state"),
    "aum": ("5f2c", "5f2ctotal", "totalraum", "regulatoryassetsundermanagement"),
}
# fixed values: filing answers kept in the profile
PROFILE = {
    "zip": "mainofficepostalcode", "country": "mainofficecountry", "website": "websiteaddress", "registered": "secstatuseffectivedate",
    "adv_date": "latestadvfilingdate", "org_type": "3a", "employees": "5a", "advisory_staff": "5b1", "clients": "5c1",
    "clients_over_100": "5c1ifmorethan100howmany", "accounts": "5f2f", "fp_clients": "5h", "wrap": "5i1",
    "offices_other": "totalnumberofofficesotherthanyourprincipalofficeandplaceofbusiness", "aum_discretionary": "5f2a",
    "private_funds": "countofprivatefunds7b1", "disclosures": "11",
}
RECORDS = "locationofbooksandrecords"
CLIENT_LETTERS = "abcdefghijklmn"


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9#]", "", (name or "").lower())


def file_dates(files: DataFrame, name: str = "name") -> DataFrame:
    """Registered-adviser files with the date in their name (MMDDYY, YYYYMMDD or MMDDYYYY); exempt files are left out."""
    low = F.lower(F.element_at(F.split(name, "/"), -1))
    digits = F.reverse(F.regexp_extract_all(low, F.lit(r"(\d{6,8})"), 1))

    def read(d: Column) -> Column:
        six = F.try_to_date(F.concat(F.lit("20"), F.substring(d, 5, 2), F.substring(d, 1, 4)), "yyyyMMdd")
        return F.when(F.length(d) == 6, six).when((F.length(d) == 8) & d.rlike("^(?:19|20)"), F.try_to_date(d, "yyyyMMdd")).when(
            F.length(d) == 8, F.try_to_date(d, "MMddyyyy"))

    dated = files.withColumn("data_date", F.get(F.array_compact(F.transform(digits, read)), F.lit(0)))
    return dated.where(F.startswith(low, F.lit("ia")) & ~F.contains(low, F.lit("era")) & ~F.contains(low, F.lit("exempt"))
                       & F.col("data_date").isNotNull())


def latest_file(files: DataFrame, name: str = "name") -> DataFrame:
    return file_dates(files, name).agg(F.max_by(name, "data_date").alias(name), F.max("data_date").alias("data_date"))


def sniff_header(spark: SparkSession, path: str) -> tuple[str, str]:
    """Delimiter and header line from the first 20 lines of the first file (by name); the first line when none looks like one."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"))
    first = lines.agg(F.min("f")).first()[0]
    top = [r[0] for r in lines.where(F.col("f") == first).limit(20).collect()]
    for line in top:
        sep = max([",", "|", "\t"], key=line.count)
        keys = {header_key(h) for h in next(csv.reader([line.lstrip("\ufeff")], delimiter=sep), [])}
        if any(k in HEADERS["crd"] or k.endswith("crd#") for k in keys) and keys & set(HEADERS["legal_name"] + HEADERS["business_name"]):
            return sep, line
    head = next((x for x in top if x.strip()), "")
    return max([",", "|", "\t"], key=head.count), head


def read_adviser_file(spark: SparkSession, path: str, data_date: str) -> DataFrame:
    """Delimited adviser extract -> typed adviser rows.

    Lines are read as text and split by the header's columns, so blank, short or foreign lines before the header (or a header
    in each file of a folder) do no harm: what holds no name and number is dropped with the other nameless rows.
    """
    sep, head = sniff_header(spark, path)
    names = next(csv.reader([head.lstrip("\ufeff")], delimiter=sep), [])
    columns = [f"c{i}" for i in range(max(1, len(names)))]
    lines = spark.read.text(path).where((F.col("value") != head) & (F.trim("value") != ""))
    raw = lines.select(F.from_csv("value", ", ".join(f"{c} string" for c in columns), {"sep": sep}).alias("r")).select("r.*")
    return advisers_from_table(raw, dict(zip(columns, names, strict=False)), data_date)


def number(value: Column) -> Column:
    """Digits and dots of a value as a double; null when nothing is left."""
    return F.regexp_replace(value, r"[^\d.]", "").try_cast("double")


def advisers_from_table(raw: DataFrame, headers: dict[str, str], data_date: str) -> DataFrame:
    """Loosely named columns -> adviser rows; exempt advisers and rows without a name or numeric crd are dropped."""
    keys: dict[str, str] = {}
    for col, name in headers.items():
        keys.setdefault(header_key(name.lstrip("﻿")), col)

    def identity(field: str) -> Column:
        for col, name in headers.items():
            k = header_key(name.lstrip("﻿"))
            if k in HEADERS[field] or (field == "crd" and k.endswith("crd#")):
                return F.nullif(F.trim(F.col(col).cast("string")), F.lit(""))
        return F.lit(None).cast("string")

    def answer(key: str) -> Column:
        return F.nullif(F.trim(F.col(keys[key]).cast("string")), F.lit("")) if key in keys else F.lit(None).cast("string")

    yes = lambda key: F.coalesce(F.upper(answer(key)) == "Y", F.lit(False))
    whole = lambda key: number(answer(key)).cast("bigint")
    crd = F.regexp_replace(identity("crd"), r"\.0$", "")
    sec_number, legal = identity("sec_number"), identity("legal_name")
    business = F.coalesce(identity("business_name"), legal)
    office = [identity("city"), identity("state"), answer(PROFILE["zip"]), answer(PROFILE["country"])]
    records = [answer(RECORDS + k) for k in ("city", "state", "postalcode", "country")]
    no_office = F.coalesce(*office).isNull()
    city, state, zip_, country = [F.when(no_office, b).otherwise(a) for a, b in zip(office, records)]
    zip5 = F.substring(F.regexp_replace(zip_, r"\D", ""), 1, 5)
    day = lambda key: F.try_to_date(F.regexp_extract(answer(key), r"^(\d{1,2}/\d{1,2}/\d{4})", 1), "M/d/yyyy")
    mix = F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in CLIENT_LETTERS]), F.array(
        *[F.coalesce(number(answer(f"5d{x}3")), F.lit(0.0)) for x in CLIENT_LETTERS])), lambda k, v: v > 0)
    picked = lambda top, item: F.array_compact(F.array(*[F.when(yes(f"{item}{i}"), F.lit(i)) for i in range(1, top + 1)]))
    clients = F.coalesce(F.nullif(number(answer(PROFILE["clients_over_100"])), F.lit(0.0)), number(answer(PROFILE["clients"])))
    profile = F.struct(
        F.lower(answer(PROFILE["website"])).alias("website"), answer(PROFILE["org_type"]).alias("org_type"),
        day(PROFILE["registered"]).alias("registered"), day(PROFILE["adv_date"]).alias("adv_date"),
        *[whole(PROFILE[k]).alias(k) for k in ("employees", "advisory_staff", "accounts", "fp_clients", "private_funds")],
        clients.cast("bigint").alias("clients"), (whole(PROFILE["offices_other"]) + 1).alias("offices"),
        number(answer(PROFILE["aum_discretionary"])).alias("aum_discretionary"), mix.alias("client_aum"),
        picked(12, "5g").alias("services"), picked(7, "5e").alias("compensation"), picked(14, "6a").alias("other_business"),
        yes(PROFILE["wrap"]).alias("wrap"), yes(PROFILE["disclosures"]).alias("disclosures"),
        (no_office & F.coalesce(zip_ != "", F.lit(False))).alias("approx_location"))
    rows = raw.select(
        crd.alias("crd"), sec_number.alias("sec_number"), F.coalesce(legal, business).alias("legal_name"),
        business.alias("business_name"), city.alias("city"), F.substring(F.upper(state), 1, 2).alias("state"),
        number(identity("aum")).alias("aum_usd"), F.lit(data_date).cast("date").alias("data_date"),
        F.when(F.length(zip5) == 5, zip5).alias("zip"), country.alias("country"), profile.alias("profile"))
    return registered_only(rows)


def registered_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("crd").rlike(r"^\d+$") & (F.col("sec_number").isNull() | F.startswith("sec_number", F.lit("801-")))
                      & F.coalesce("legal_name", "business_name").isNotNull())


def last_row_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """An adviser on several sheets keeps its last row (a partial aggregate, no sort)."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ZIP gazetteer -> (zip, lat, lon)."""
    raw = spark.read.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True).csv(path)
    return zip_rows(raw.toDF(*[c.strip().upper() for c in raw.columns]))


def zip_rows(raw: DataFrame) -> DataFrame:
    lat, lon = F.col("INTPTLAT").try_cast("double"), F.col("INTPTLONG").try_cast("double")
    return raw.where(F.col("GEOID").rlike(r"^\d+$")).select(F.lpad("GEOID", 5, "0").alias("zip"), lat.alias("lat"), lon.alias("lon")).where(
        "lat is not null and lon is not null")
