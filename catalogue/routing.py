"""P and J: checks on single requests, credentials and language sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs
from catalogue.inputs import INSTALLED, MODEL_LANGUAGES
from catalogue.registry import query
from earshot.operators import route
from earshot.sources import registry

RAW = f"raw AS ({inputs.raw_requests_sql()}), creds AS ({inputs.credentials_sql()})"
_PACKS = "[" + ", ".join(f"'{c}'" for c in INSTALLED) + "]"
_MODEL = "[" + ", ".join(f"'{c}'" for c in MODEL_LANGUAGES) + "]"
UUID_RE = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
PLAYER = "replace(regexp_replace(replace(replace(player_id, 'urn:', ''), 'uuid:', ''), '^[{}]+|[{}]+$', '', 'g'), '-', '')"
PLAYER_UUID = rf"regexp_replace(lower({PLAYER}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\1-\2-\3-\4-\5')"
PLAYER_OK = f"regexp_matches({PLAYER}, '^[0-9a-fA-F]{{32}}$')"
SPEC_OK = """(language_spec = 'auto' OR (len(string_split(language_spec, ',')) <= 25
  AND regexp_matches(language_spec, '^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*(,[a-z]{2,3}(-[A-Za-z0-9]{2,8})*)*$')
  AND len(list_distinct(string_split(language_spec, ','))) = len(string_split(language_spec, ','))))"""
PREROLL_OK = """coalesce(try_cast(trim(preroll) AS BIGINT) >= 0 AND try_cast(trim(preroll) AS BIGINT) <= 384000
  AND try_cast(trim(preroll) AS BIGINT) % 3 = 0, false)"""
PARTIAL = "CASE WHEN partial_flag IS NULL THEN false WHEN trim(partial_flag) = '0' THEN false WHEN trim(partial_flag) = '1' THEN true END"
EXPIRED = "coalesce(occurred_at >= expires_at, false)"

# Requests with their credential and language sets, in the order a SQL engine keeps lists.
ROUTED = f"""{RAW},
attached AS (SELECT raw.*, creds.* EXCLUDE (token_digest) FROM raw LEFT JOIN creds ON sha256(token) = creds.token_digest),
sets AS (SELECT *, CASE WHEN language_spec = 'auto' THEN []::VARCHAR[] ELSE string_split(language_spec, ',') END AS requested,
  CASE WHEN languages IS NULL THEN {_PACKS} ELSE list_filter({_PACKS}, lambda x: list_contains(languages, x)) END AS entitled,
  nullif(detected_language, '') AS detected, {PARTIAL} AS partial FROM attached),
routed AS (SELECT *, CASE WHEN len(requested) > 0 THEN list_filter(list_distinct(requested), lambda x: list_contains(entitled, x)) ELSE entitled END AS moderatable,
  CASE WHEN len(requested) > 0 THEN list_filter(requested, lambda x: list_contains(entitled, x))
    WHEN detected IS NULL THEN entitled ELSE list_filter([detected], lambda x: list_contains(entitled, x)) END AS run_packs FROM sets),
checked AS (SELECT *, CASE WHEN server_id IS NULL THEN 'unauthorized' WHEN {EXPIRED} THEN 'license_expired' END AS gate,
  CASE WHEN NOT regexp_matches(request_id, '{UUID_RE}') THEN 'invalid_request_id' WHEN NOT {PLAYER_OK} THEN 'invalid_player_id'
  WHEN NOT {SPEC_OK} THEN 'invalid_language' WHEN NOT {PREROLL_OK} THEN 'invalid_preroll' WHEN partial IS NULL THEN 'invalid_partial'
  WHEN languages IS NOT NULL AND len(list_filter(requested, lambda x: NOT list_contains(languages, x))) > 0 THEN 'language_not_licensed'
  WHEN len(moderatable) = 0 THEN 'language_unsupported' END AS refusal,
  CASE WHEN len(requested) > 0 AND NOT list_contains({_MODEL}, requested[1]) THEN 'language_unsupported'
  WHEN len(requested) = 0 AND detected IS NOT NULL AND NOT list_contains({_MODEL}, detected) THEN 'unsupported_detected_language' END AS model_refusal
FROM routed)"""


def routed(spark, sf):
    attached = route.attach_credentials(inputs.raw_requests(spark, sf), inputs.credentials(spark))
    return route.with_routing(attached, INSTALLED, MODEL_LANGUAGES)


def _field(name, expression, sql):
    @query(name, f"WITH {RAW} SELECT row_id, {sql} AS ok FROM raw")
    def run(spark, sf):
        return inputs.raw_requests(spark, sf).select("row_id", expression().alias("ok"))


_field("p2_canonical_uuid", lambda: route.is_canonical_uuid(F.col("request_id")), f"regexp_matches(request_id, '{UUID_RE}')")
_field("p2b_player_uuid", lambda: route.is_any_uuid(F.col("player_id")), PLAYER_OK)
_field("p3_language_spec", lambda: route.is_language_spec(F.col("language_spec")), SPEC_OK)
_field("p4_partial_flag", lambda: route.partial_flag(F.col("partial_flag")), PARTIAL)
_field("p5_preroll", lambda: route.is_preroll(F.col("preroll")), PREROLL_OK)


@query("p1_validation_cascade", f"""WITH {ROUTED}
SELECT row_id, coalesce(gate, refusal, model_refusal, 'success') AS outcome FROM checked""")
def cascade(spark, sf):
    outcome = F.coalesce(
        route.gate_outcome(), route.metadata_outcome(), route.model_outcome(MODEL_LANGUAGES), F.lit("success")
    )
    return routed(spark, sf).select("row_id", outcome.alias("outcome"))


@query("p6_expiry", f"WITH {ROUTED} SELECT row_id FROM checked WHERE {EXPIRED}")
def expired(spark, sf):
    return routed(spark, sf).filter(route.is_expired(F.col("occurred_at"), F.col("expires_at"))).select("row_id")


def _chosen(name, where, sql_where):
    # Only of well-formed specs; a repeated code is refused before packs are chosen.
    @query(name, f"""WITH {ROUTED}
SELECT row_id, (i - 1)::INTEGER AS pack_ord, run_packs[i] AS language FROM
  (SELECT row_id, run_packs, unnest(range(1, len(run_packs) + 1)) AS i FROM checked WHERE {sql_where} AND {SPEC_OK})""")
    def run(spark, sf):
        valid = route.is_language_spec(F.col("language_spec"))
        return routed(spark, sf).filter(where).filter(valid).select(
            "row_id", F.posexplode("run_packs").alias("pack_ord", "language")
        )


_chosen("j1_pinned_packs", "size(requested) > 0", "len(requested) > 0")
_chosen("j2_auto_undetected", "size(requested) = 0 AND detected IS NULL", "len(requested) = 0 AND detected IS NULL")
_chosen("j3_auto_detected", "size(requested) = 0 AND detected IS NOT NULL", "len(requested) = 0 AND detected IS NOT NULL")


@query("j4_entitled", f"WITH {ROUTED} SELECT row_id, array_to_string(entitled, ',') AS entitled FROM checked")
def entitled(spark, sf):
    return routed(spark, sf).select("row_id", F.array_join("entitled", ",").alias("entitled"))


@query("j5_not_licensed", f"""WITH {ROUTED} SELECT row_id, language_spec FROM checked
WHERE languages IS NOT NULL AND len(list_filter(requested, lambda x: NOT list_contains(languages, x))) > 0""")
def not_licensed(spark, sf):
    outside = F.size(F.array_except("requested", "languages")) > 0
    return routed(spark, sf).filter(F.col("languages").isNotNull() & outside).select("row_id", "language_spec")


@query("j6_no_pack", f"WITH {ROUTED} SELECT row_id FROM checked WHERE len(moderatable) = 0")
def no_pack(spark, sf):
    return routed(spark, sf).filter(F.size("moderatable") == 0).select("row_id")


@query("j7_model_refusal", f"WITH {ROUTED} SELECT row_id, model_refusal FROM checked WHERE model_refusal IS NOT NULL")
def model_refusal(spark, sf):
    return routed(spark, sf).select("row_id", route.model_outcome(MODEL_LANGUAGES).alias("model_refusal")).filter(
        "model_refusal IS NOT NULL"
    )


# A model per market segment that hears the languages its customers' nations begin with;
# a pack for each language of the documents.
MODELS_SQL = """heard AS (SELECT DISTINCT c_mktsegment AS model_id, lower(substr(n_name, 1, 2)) AS language
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
packs AS (SELECT DISTINCT lang AS language FROM documents)"""


def _models(spark, sf):
    nations = inputs.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.lower(F.substring("n_name", 1, 2)).alias("language")
    )
    heard = inputs.table(spark, sf, "customer").join(nations, "c_nationkey")
    return heard.groupBy(F.col("c_mktsegment").alias("model_id")).agg(
        F.array_sort(F.collect_set("language")).alias("languages")
    )


def _packed(spark, sf):
    return inputs.table(spark, sf, "documents").select(F.col("lang").alias("language"))


@query("j8_languages_without_packs", f"""WITH {MODELS_SQL}
SELECT model_id, language FROM heard WHERE language NOT IN (SELECT language FROM packs)""")
def without_packs(spark, sf):
    return route.languages_without_packs(_models(spark, sf), _packed(spark, sf))


@query("j9_packs_without_model", f"""WITH {MODELS_SQL}
SELECT model_id, language FROM (SELECT DISTINCT model_id FROM heard), packs
WHERE (model_id, language) NOT IN (SELECT (model_id, language) FROM heard)""")
def without_model(spark, sf):
    return route.packs_without_model(_models(spark, sf), _packed(spark, sf))


@query("j10_moderated_languages", f"""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ['fr', 'en']
  WHEN 2 THEN ['en', 'fi'] ELSE ['xx'] END AS languages FROM customer)
SELECT c_custkey, array_to_string(list_sort(CASE WHEN languages IS NULL THEN {_PACKS}
  ELSE list_filter({_PACKS}, lambda x: list_contains(languages, x)) END), ',') AS moderated FROM c""")
def moderated(spark, sf):
    key = F.col("c_custkey") % 4

    def codes(*values):
        return F.array(*map(F.lit, values))

    licensed = F.when(key == 1, codes("fr", "en")).when(key == 2, codes("en", "fi")).when(key == 3, codes("xx"))
    return inputs.table(spark, sf, "customer").select(
        "c_custkey", F.array_join(route.moderated_languages(INSTALLED, licensed), ",").alias("moderated")
    )


@query("j11_credentials", f"""WITH {RAW}
SELECT row_id, server_id, tenant_key, server_id IS NOT NULL AS known FROM raw LEFT JOIN creds ON sha256(token) = creds.token_digest""")
def credentials(spark, sf):
    attached = route.attach_credentials(inputs.raw_requests(spark, sf), inputs.credentials(spark))
    return attached.select("row_id", "server_id", "tenant_key", F.col("server_id").isNotNull().alias("known"))


# A catalog with a language per nation prefix, its standing drawn from its customers.
CATALOG_SQL = """catalog AS (SELECT code, CASE n % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'draft' WHEN 2 THEN 'reviewed' ELSE 'verified' END AS rule_pack,
  n % 3 = 0 AS cloud_selectable, code = 'et' AS cloud_base FROM
  (SELECT lower(substr(n_name, 1, 2)) AS code, sum(c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1))"""


def catalog(spark, sf):
    nations = inputs.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.lower(F.substring("n_name", 1, 2)).alias("code")
    )
    counted = inputs.table(spark, sf, "customer").join(nations, "c_nationkey").groupBy("code").agg(
        F.sum("c_custkey").alias("n")
    )
    statuses = F.array(*map(F.lit, ("none", "draft", "reviewed", "verified")))
    return counted.select(
        "code", F.col("code").alias("name"), (F.col("code") == "et").alias("cloud_base"),
        (F.col("n") % 3 == 0).alias("cloud_selectable"), F.array(F.lit("m")).alias("models"),
        F.get(statuses, (F.col("n") % 4).cast("int")).alias("rule_pack"), F.lit("pilot").alias("evidence"),
    )


@query("j12_catalog_codes", f"""WITH {CATALOG_SQL}
SELECT 'moderation' AS kind, code FROM catalog WHERE rule_pack <> 'none'
UNION ALL SELECT 'selectable', code FROM catalog WHERE cloud_selectable
UNION ALL SELECT 'base', code FROM catalog WHERE cloud_base""")
def catalog_codes(spark, sf):
    table = catalog(spark, sf)
    kinds = (("moderation", registry.moderation_codes), ("selectable", registry.selectable_codes), ("base", registry.base_code))
    parts = [pick(table).select(F.lit(kind).alias("kind"), "code") for kind, pick in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("j13_model_supports", f"""WITH {MODELS_SQL}
SELECT model_id, coalesce(bool_or(language = 'et'), false) AS supported FROM heard GROUP BY model_id""")
def supports(spark, sf):
    return _models(spark, sf).select("model_id", registry.supports_language("et").alias("supported"))
