"""Small dimensions: the language catalog, the model registry, server credentials."""

from __future__ import annotations

import tomllib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot import domains, schemas

_CATALOG_KEYS = {f.name for f in schemas.LANGUAGE_CATALOG.fields}


def _toml(spark: SparkSession, path: str, keys: set[str], schemas_allowed: tuple[int, ...], what: str) -> dict:
    """One document, from wherever Spark can read: a file, or a folder of its pieces in the order of their names."""
    pieces = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").orderBy("file")
    document = tomllib.loads("\n".join(r["value"] for r in pieces.toLocalIterator()))
    if set(document) != keys or document["schema"] not in schemas_allowed:
        raise ValueError(f"{what} must hold exactly {sorted(keys)} with a known schema")
    return document


def read_language_catalog(spark: SparkSession, path: str) -> DataFrame:
    """TOML catalog as a table, once check_language_catalog finds nothing wrong."""
    document = _toml(spark, path, {"schema", "languages"}, (1,), "language catalog")
    entries = document["languages"]
    for entry in entries:
        if not isinstance(entry, dict) or set(entry) != _CATALOG_KEYS:
            raise ValueError(f"language entry keys must be {sorted(_CATALOG_KEYS)}")
    catalog = spark.createDataFrame(
        [tuple(e[f.name] for f in schemas.LANGUAGE_CATALOG.fields) for e in entries],
        schemas.LANGUAGE_CATALOG,
    )
    faults = check_language_catalog(catalog).limit(20).collect()
    if faults:
        raise ValueError("language catalog: " + "; ".join(f"{r.code}: {r.fault}" for r in faults))
    return catalog.withColumn("name", F.trim("name"))


def check_language_catalog(catalog: DataFrame) -> DataFrame:
    """Rows (code, fault) for every invariant a catalog breaks; empty means sound."""
    code = F.col("code")
    row_faults: tuple[tuple[str, Column], ...] = (
        ("auto is not a language", code == "auto"),
        ("invalid code", ~code.rlike(r"\A[a-z]{2,3}\z") & (code != "auto")),
        ("empty name", F.trim("name") == ""),
        ("models must be listed", F.size("models") < 1),
        ("models must not be blank", F.array_contains("models", "")),
        ("models must be unique", F.size(F.array_distinct("models")) != F.size("models")),
        ("invalid rule_pack", ~F.col("rule_pack").isin(*domains.PACK_STATUSES)),
        ("invalid evidence", ~F.col("evidence").isin(*domains.EVIDENCE_LEVELS)),
        ("base language must be selectable", F.col("cloud_base") & ~F.col("cloud_selectable")),
        ("selectable needs a verified pack", F.col("cloud_selectable") & (F.col("rule_pack") != "verified")),
        ("base language must be en", F.col("cloud_base") & (code != "en")),
    )
    found = F.filter(
        F.array(*[F.when(broken, F.lit(fault)) for fault, broken in row_faults]),
        lambda fault: fault.isNotNull(),
    )
    per_row = catalog.select("code", F.explode(found).alias("fault"))
    repeated = catalog.groupBy("code").count().filter("count > 1").select(
        "code", F.lit("duplicate code").alias("fault")
    )
    bases = catalog.agg(F.count_if("cloud_base").alias("n")).filter("n <> 1").select(
        F.lit(None).cast("string").alias("code"), F.lit("exactly one base language").alias("fault")
    )
    return per_row.unionByName(repeated).unionByName(bases)


def moderation_codes(catalog: DataFrame) -> DataFrame:
    return catalog.filter("rule_pack <> 'none'").select("code")


def selectable_codes(catalog: DataFrame) -> DataFrame:
    return catalog.filter("cloud_selectable").select("code")


def base_code(catalog: DataFrame) -> DataFrame:
    return catalog.filter("cloud_base").select("code")


def read_model_registry(spark: SparkSession, path: str) -> DataFrame:
    """Model id, family and languages; the download pins are of no use here."""
    document = _toml(spark, path, {"schema", "models"}, (1, 2), "model registry")
    models = document["models"]
    if not models:
        raise ValueError("model registry must contain models")
    repeated = [m for m, n in Counter(m["id"] for m in models).items() if n > 1]
    if repeated:
        raise ValueError(f"duplicate model id: {repeated[0]}")
    rows = [(m["id"], m["family"], list(m["languages"])) for m in models]
    return spark.createDataFrame(rows, schemas.MODELS)


def supports_language(language: str | Column) -> Column:
    return F.array_contains("languages", language)


# --- credentials -----------------------------------------------------------------

_CREDENTIAL_KEYS = ("token", "plan", "languages", "rate-limit-per-minute", "expires")


_ISO_DATE = r"(\d{4})(?:-(\d\d)-(\d\d)|(\d\d)(\d\d)|-W(\d\d)(?:-(\d))?|W(\d\d)(\d)?)"
_ISO_CLOCK = r"(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?"
_ISO_OFFSET = r"(?:(Z)|([+-])(\d\d)(?::?(\d\d)(?::?(\d\d)(?:\.(\d+))?)?)?)"
_ISO = rf"\A{_ISO_DATE}(?:[\s\S]{_ISO_CLOCK}{_ISO_OFFSET}?)?\z"
# Hours, minutes and seconds are written all with colons or all without.
_MIXED = r"\d\d:\d\d\d\d|\d\d\d\d:\d\d\z|[\s\S]\d\d\d\d:"


def iso_moment(text: Column) -> Column:
    """The moment an ISO 8601 text names, UTC unless it has an offset; null if it is none.

    Calendar and week dates, with or without hyphens, alone or with a time of day after
    any one character. The session's zone plays no part.
    """

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, _ISO, i), F.lit("")).cast("int")

    def fraction(i: int) -> Column:
        return F.rpad(F.substring(F.regexp_extract(text, _ISO, i), 1, 6), 6, "0").cast("int")

    year, week = group(1), F.coalesce(group(6), group(8))
    weekday = F.coalesce(group(7), group(9), F.lit(1))
    fourth = F.make_date(F.nullif(year, F.lit(0)), F.lit(1), F.lit(4))
    by_week = F.date_add(fourth, (week - 1) * 7 + weekday - 1 - F.weekday(fourth))
    week_ok = weekday.between(1, 7) & (week >= 1) & (F.extract(F.lit("YEAROFWEEK"), by_week) == year)
    zero = F.lit(0)
    month, day = F.coalesce(group(2), group(4)), F.coalesce(group(3), group(5))
    date = F.when(week.isNotNull(), F.when(week_ok, by_week)).otherwise(
        F.to_date(F.try_make_timestamp(years=F.nullif(year, zero), months=month, days=day, hours=zero, mins=zero, secs=zero.cast("decimal(8,6)")))
    )
    hour, minute, second = (F.coalesce(group(i), zero) for i in (10, 11, 12))
    off_hour, off_minute, off_second = (F.coalesce(group(i), zero) for i in (16, 17, 18))
    clock = (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000 + fraction(13)
    offset = (off_hour * 3600 + off_minute * 60 + off_second).cast("long") * 1_000_000 + fraction(19)
    sign = F.when(F.regexp_extract(text, _ISO, 15) == "-", -1).otherwise(1)
    ok = (
        text.rlike(_ISO) & ~F.substring(text, 9, 30).rlike(_MIXED) & date.isNotNull() & (hour < 24) & (minute < 60) & (second < 60)
        & (off_hour < 24) & (off_minute < 60) & (off_second < 60)
    )
    return F.when(ok, F.timestamp_micros(F.unix_date(date).cast("long") * 86_400_000_000 + clock - sign * offset))


def parse_credentials(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(credentials, rejects) from rows (source_path, value) of JSON text.

    The JSON is one object per file, server id to token or to an object of limits. A
    reject row names the first thing wrong with an entry. Tokens leave as digests only.
    """
    parsed = files.select(
        "source_path", F.from_json("value", "map<string,variant>").alias("entries")
    )
    unreadable = parsed.filter(F.col("entries").isNull() | (F.size("entries") < 1)).select(
        "source_path", F.lit(None).cast("string").alias("server_id"), F.lit("invalid_file").alias("code")
    )
    entry = F.col("entry")
    raw = parsed.select("source_path", F.explode("entries").alias("server_id", "entry")).withColumn(
        "kind", F.schema_of_variant("entry")
    )
    is_object = F.col("kind").startswith("OBJECT<")

    def value(path: str, kind: str) -> Column:
        return F.try_variant_get(entry, f"$['{path}']", kind)

    def json_type(path: str) -> Column:
        found = F.try_variant_get(entry, f"$['{path}']", "variant")
        return F.coalesce(F.schema_of_variant(found), F.lit("VOID"))

    keys = F.map_keys(F.try_variant_get(entry, "$", "map<string,variant>"))
    typed = raw.select(
        "source_path", "server_id", "kind",
        F.array_except(keys, F.array(*map(F.lit, _CREDENTIAL_KEYS))).alias("unknown_keys"),
        F.when(F.col("kind") == "STRING", F.try_variant_get(entry, "$", "string"))
        .when(json_type("token") == "STRING", value("token", "string"))
        .alias("token"),
        F.when(~is_object | (json_type("plan") == "VOID") & ~F.array_contains(keys, "plan"), F.lit("selfhost"))
        .when(json_type("plan") == "STRING", value("plan", "string"))
        .alias("plan"),
        json_type("languages").alias("languages_type"),
        value("languages", "array<string>").alias("languages"),
        json_type("rate-limit-per-minute").alias("limit_type"),
        value("rate-limit-per-minute", "int").alias("rate_limit_per_minute"),
        json_type("expires").alias("expires_type"),
        iso_moment(value("expires", "string")).alias("expires_at"),
    )
    code_ok = lambda c: c.rlike(rf"\A{domains.CREDENTIAL_LANGUAGE}\z")
    good_languages = (F.col("languages_type") == "VOID") | (
        (F.col("languages_type") == "ARRAY<STRING>")
        & (F.size("languages") > 0)
        & F.forall("languages", code_ok)
    )
    good_limit = (F.col("limit_type") == "VOID") | (
        (F.col("limit_type") == "BIGINT")
        & F.col("rate_limit_per_minute").between(1, domains.MAX_RATE_LIMIT)
    )
    good_expiry = (F.col("expires_type") == "VOID") | (
        (F.col("expires_type") == "STRING") & F.col("expires_at").isNotNull()
    )
    checks = tuple(
        (name, ~F.coalesce(good, F.lit(False)))
        for name, good in (
            ("invalid_server_id", F.col("server_id").rlike(rf"\A{domains.SERVER_ID}\z")),
            ("invalid_entry", (F.col("kind") == "STRING") | F.col("kind").startswith("OBJECT<")),
            ("unknown_keys", F.coalesce(F.size("unknown_keys"), F.lit(0)) <= 0),
            ("invalid_token", F.col("token") != ""),
            ("invalid_plan", F.col("plan").rlike(rf"\A{domains.PLAN}\z")),
            ("invalid_languages", good_languages),
            ("invalid_rate_limit", good_limit),
            ("invalid_expiry", good_expiry),
        )
    )
    code = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in checks])
    checked = typed.select(
        "*", code.alias("code"), F.unhex(F.sha2("token", 256)).alias("token_digest")
    )
    same_token = Window.partitionBy("source_path", "token_digest")
    checked = checked.withColumn(
        "code",
        F.coalesce(
            "code",
            F.when(F.count(F.when(F.col("code").isNull(), True)).over(same_token) > 1, F.lit("duplicate_token")),
        ),
    )
    credentials = checked.filter("code IS NULL").select(
        "server_id", "token_digest", F.lit(None).cast("string").alias("tenant_key"), "plan",
        F.array_sort(F.array_distinct("languages")).alias("languages"),
        "rate_limit_per_minute", "expires_at",
    )
    rejects = checked.filter("code IS NOT NULL").select("source_path", "server_id", "code")
    return credentials, rejects.unionByName(unreadable)


def read_credentials(spark: SparkSession, path: str) -> DataFrame:
    """Credentials of a tokens file; any reject refuses the file."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_path"), "value"
    )
    credentials, rejects = parse_credentials(files)
    first = rejects.limit(1).collect()
    if first:
        raise ValueError(f"credentials: {first[0].code} ({first[0].server_id})")
    return credentials
