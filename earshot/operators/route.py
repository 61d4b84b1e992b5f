"""Who is asking, may they, and which packs their transcript runs through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import domains
from earshot.plans.sizing import broadcast_if_bounded

_PYTHON_INT = r"\A\s*[+-]?[0-9]+(?:_[0-9]+)*\s*\z"


# --- checks on single fields -------------------------------------------------------


def is_canonical_uuid(value: Column) -> Column:
    """Lower-case hyphenated form only: replays are recognised by this very string."""
    return F.coalesce(value.rlike(r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), F.lit(False))


def is_any_uuid(value: Column) -> Column:
    """Any spelling Python's uuid.UUID reads: upper case, braces, urn prefix, no hyphens."""
    bare = F.replace(F.replace(value, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    bare = F.replace(F.regexp_replace(bare, r"\A[{}]+|[{}]+\z", ""), F.lit("-"), F.lit(""))
    hexadecimal = r"\A\s*\+?(?:0[xX]_?)?[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*\s*\z"
    return F.coalesce((F.length(bare) == 32) & bare.rlike(hexadecimal), F.lit(False))


def canonical_uuid(value: Column) -> Column:
    """The lower-case hyphenated form of any spelling is_any_uuid takes; null for others."""
    bare = F.replace(F.replace(value, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    bare = F.replace(F.regexp_replace(bare, r"\A[{}]+|[{}]+\z", ""), F.lit("-"), F.lit(""))
    # What a number may be written with beside its digits, then the zeros those stood for.
    digits = F.lpad(F.lower(F.regexp_replace(bare, r"\A\s*\+?(?:0[xX])?|_|\s", "")), 32, "0")
    return F.when(is_any_uuid(value), F.regexp_replace(digits, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))


def is_language_spec(spec: Column) -> Column:
    """auto, or up to 25 well-formed codes without repeats."""
    codes = F.split(spec, ",")
    listed = (
        (F.size(codes) <= domains.MAX_REQUEST_LANGUAGES)
        & spec.rlike(rf"\A{domains.PACK_LANGUAGE}(?:,{domains.PACK_LANGUAGE})*\z")
        & (F.size(F.array_distinct(codes)) == F.size(codes))
    )
    return F.coalesce((spec == "auto") | listed, F.lit(False))


def preroll_samples(value: Column) -> Column:
    """The number a preroll is written as; null if it is none."""
    return F.when(value.rlike(_PYTHON_INT), F.regexp_replace(value, "_|\\s", "").try_cast("bigint"))


def is_preroll(value: Column, max_samples: int = domains.MAX_PREROLL_SAMPLES_48K) -> Column:
    samples = preroll_samples(value)
    ok = (samples >= 0) & (samples <= max_samples) & (samples % 3 == 0)
    return F.coalesce(ok, F.lit(False))


def partial_flag(value: Column) -> Column:
    """True or false; null when the flag is present and neither 0 nor 1."""
    stripped = F.regexp_replace(value, r"\A\s+|\s+\z", "")
    return F.when(value.isNull(), False).when(stripped == "0", False).when(stripped == "1", True)


def is_expired(occurred_at: Column, expires_at: Column) -> Column:
    return F.coalesce(occurred_at >= expires_at, F.lit(False))


# --- language sets -----------------------------------------------------------------


def requested_languages(spec: Column) -> Column:
    """Codes in the order asked for; empty for auto."""
    return F.when(spec == "auto", F.array().cast("array<string>")).otherwise(F.split(spec, ","))


def entitled_languages(installed: Sequence[str], licensed: Column) -> Column:
    """Installed packs the licence covers, in file order; no list means all of them."""
    packs = F.array(*map(F.lit, installed)).cast("array<string>")
    return F.when(licensed.isNull(), packs).otherwise(F.array_intersect(packs, licensed))


def languages_to_run(requested: Column, entitled: Column, detected: Column) -> Column:
    """Packs to run: the request's order if pinned, else the detected one, else all."""
    return (
        F.when(F.size(requested) > 0, F.array_intersect(requested, entitled))
        .when(detected.isNull(), entitled)
        .otherwise(F.array_intersect(F.array(detected), entitled))
    )


def verdict_language(requested: Column, detected: Column) -> Column:
    """The first pinned code, else the detected language; null stands for auto."""
    return F.coalesce(F.get(requested, 0), detected)


def heard_language(detected: Column, model_languages: Sequence[str] | None) -> Column:
    """What the model says it heard; one that knows a single language always heard that."""
    if model_languages is not None and len(model_languages) == 1:
        return F.lit(model_languages[0])
    return F.nullif(F.nullif(detected, F.lit("")), F.lit("auto"))


def moderated_languages(installed: Sequence[str], licensed: Column) -> Column:
    """For a credential: licence and installed packs together, sorted."""
    return F.array_sort(entitled_languages(installed, licensed))


def languages_without_packs(models: DataFrame, rules: DataFrame) -> DataFrame:
    """(model_id, language) a model can transcribe and nothing can moderate."""
    heard = models.select("model_id", F.explode("languages").alias("language"))
    return heard.join(rules.select("language").distinct(), "language", "left_anti").select(
        "model_id", "language"
    )


def packs_without_model(models: DataFrame, rules: DataFrame) -> DataFrame:
    """(model_id, language) with a pack that a model will never produce text for."""
    packs = rules.agg(F.collect_set("language")).scalar()
    return models.select("model_id", F.explode(F.array_except(packs, F.col("languages"))).alias("language"))


# --- the cascade -------------------------------------------------------------------


def attach_credentials(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """Server, tenant and limits by token digest; all null for an unknown token."""
    known = credentials.select(
        "token_digest", "server_id", "tenant_key", "languages", "rate_limit_per_minute", "expires_at"
    )
    return requests.join(broadcast_if_bounded(known), "token_digest", "left")


def gate_outcome() -> Column:
    """What ends a request before its metadata is read; null lets it on."""
    return F.when(F.col("server_id").isNull(), "unauthorized").when(
        is_expired(F.col("occurred_at"), F.col("expires_at")), "license_expired"
    )


def metadata_outcome() -> Column:
    """The first check the metadata or the entitlement fails; null lets it on.

    Expects the columns with_routing() adds.
    """
    outside = F.size(F.array_except("requested", "languages")) > 0
    checks: tuple[tuple[str, Column], ...] = (
        ("invalid_request_id", ~is_canonical_uuid(F.col("request_id"))),
        ("invalid_player_id", ~is_any_uuid(F.col("player_id"))),
        ("invalid_language", ~is_language_spec(F.col("language_spec"))),
        ("invalid_preroll", ~is_preroll(F.col("preroll"))),
        ("invalid_partial", F.col("partial").isNull()),
        ("language_not_licensed", F.col("languages").isNotNull() & outside),
        ("language_unsupported", F.size("moderatable") == 0),
    )
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in checks])


def model_outcome(model_languages: Sequence[str] | None) -> Column:
    """Why the speech model could not serve an admitted request; null if it could."""
    if model_languages is None:
        return F.lit(None).cast("string")
    known = F.array(*map(F.lit, model_languages)).cast("array<string>")
    first = F.get("requested", 0)
    return F.when(first.isNotNull() & ~F.array_contains(known, first), "language_unsupported").when(
        first.isNull() & F.col("detected").isNotNull() & ~F.array_contains(known, F.col("detected")),
        "unsupported_detected_language",
    )


def with_routing(
    requests: DataFrame, installed: Sequence[str], model_languages: Sequence[str] | None = None
) -> DataFrame:
    """Adds partial, requested, detected, run_packs, verdict_language and what they rest on.

    player_uuid and preroll_samples are the player and the preroll however they are spelled.
    """
    spec = F.coalesce("language_spec", F.lit(""))
    return (
        requests.withColumn("partial", partial_flag(F.col("partial_flag")))
        .withColumn("player_uuid", canonical_uuid(F.col("player_id")))
        .withColumn("preroll_samples", preroll_samples(F.col("preroll")))
        .withColumn("requested", requested_languages(spec))
        .withColumn("detected", heard_language(F.col("detected_language"), model_languages))
        .withColumn("entitled", entitled_languages(installed, F.col("languages")))
        .withColumn(
            "moderatable",
            F.when(F.size("requested") > 0, F.array_intersect("requested", "entitled")).otherwise(
                F.col("entitled")
            ),
        )
        .withColumn("run_packs", languages_to_run(F.col("requested"), F.col("entitled"), F.col("detected")))
        .withColumn("verdict_language", verdict_language(F.col("requested"), F.col("detected")))
        .withColumn("packs_run", F.size("run_packs"))
    )
