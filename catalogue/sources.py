"""S: packs, catalogs, registries and credentials read from files the tables are turned into."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs
from catalogue.inputs import WORDS_SQL
from catalogue.packqa import RULED
from catalogue.registry import query
from catalogue.routing import CATALOG_SQL, MODELS_SQL, _models, catalog
from earshot.plans.sizing import scratch_dir
from earshot.sources import packs as pack_source
from earshot.sources import registry


@query("s1_pack_patterns", f"""WITH {RULED}
SELECT language, rule_id, word AS pattern, CASE WHEN fuzzy THEN 'fuzzy' ELSE 'exact' END AS match_type, category, severity,
  review AS context_required, (dense_rank() OVER (ORDER BY language) - 1)::INTEGER AS pack_ord FROM ruled""")
def pack_patterns(spark, sf):
    packs = inputs.word_packs(spark, sf)
    rules = packs.rules.select("language", "rule_id", "category", "severity", "context_required", "pack_ord")
    return packs.patterns.select("language", "rule_id", "pattern", "match_type").join(
        rules, ["language", "rule_id"]
    )


# One pack per word, spoiled in the way its hash says.
SPOILT = """CASE substr(md5(word), 9, 1) WHEN '0' THEN 'invalid_category' WHEN '1' THEN 'invalid_severity' WHEN '2' THEN 'invalid_match_type'
  WHEN '3' THEN 'invalid_rule_id' WHEN '4' THEN 'invalid_language' WHEN '5' THEN 'fuzzy_pattern_not_single_token'
  WHEN '6' THEN 'empty_regex' WHEN '7' THEN 'invalid_regex' WHEN '8' THEN 'regex_rule_needs_probe' WHEN '9' THEN 'invalid_allow'
  WHEN 'a' THEN 'allow_shadows_rule' WHEN 'b' THEN 'invalid_context_required' WHEN 'c' THEN 'regex_probe_does_not_match'
  WHEN 'd' THEN 'invalid_yaml' WHEN 'e' THEN 'invalid_pack' END"""


@query("s2_pack_rejects", f"""WITH {WORDS_SQL}, f AS (SELECT lang, word, {SPOILT} AS code FROM words)
SELECT concat('/packs/', lang, '-', word, '.yml') AS source_path, code,
  CASE code WHEN 'fuzzy_pattern_not_single_token' THEN concat(word, ' ', word) WHEN 'allow_shadows_rule' THEN word
    WHEN 'regex_probe_does_not_match' THEN word END AS detail FROM f WHERE code IS NOT NULL""")
def pack_rejects(spark, sf):
    pieces = F.expr(f"""named_struct(
      'version', if(code = 'invalid_pack', '2', '1'), 'language', if(code = 'invalid_language', '"E N"', 'en'),
      'id', if(code = 'invalid_rule_id', 'Bad Id', 'en.x'), 'category', if(code = 'invalid_category', 'rude', 'spam'),
      'severity', if(code = 'invalid_severity', 'true', '1'), 'context', if(code = 'invalid_context_required', '1', 'false'),
      'match', CASE WHEN code = 'invalid_match_type' THEN 'prefix' WHEN code = 'fuzzy_pattern_not_single_token' THEN 'fuzzy'
        WHEN code IN ('empty_regex', 'invalid_regex', 'regex_rule_needs_probe', 'regex_probe_does_not_match') THEN 'regex' ELSE 'exact' END,
      'term', CASE code WHEN 'fuzzy_pattern_not_single_token' THEN concat(word, ' ', word) WHEN 'empty_regex' THEN '(x|)'
        WHEN 'invalid_regex' THEN '(' WHEN 'regex_probe_does_not_match' THEN concat(word, 'qx') ELSE word END,
      'probe', if(code = 'regex_rule_needs_probe', '', concat(', probe: "', word, '"')),
      'allow', CASE code WHEN 'invalid_allow' THEN 'allow: ["!!"]' WHEN 'allow_shadows_rule' THEN concat('allow: ["', word, '"]') ELSE '' END)""")
    f = inputs.pack_words(spark, sf).withColumn("code", F.expr(SPOILT)).withColumn("p", pieces)
    text = F.expr("""concat(if(code = 'invalid_yaml', '{', ''), 'version: ', p.version, '\nlanguage: ', p.language, '\n', p.allow, '\nrules:\n  - {id: ', p.id, ', term: "', p.term,
      '", category: ', p.category, ', severity: ', p.severity, ', match: ', p.match, ', context_required: ', p.context, p.probe, '}\n')""")
    files = f.select(
        F.concat(F.lit("/packs/"), "lang", F.lit("-"), "word", F.lit(".yml")).alias("source_path"), text.cast("binary").alias("content")
    )
    return pack_source.parse_packs(files).filter("entry = 'fault'").select("source_path", "code", "detail")


@query("s3_catalog_faults", f"""WITH {CATALOG_SQL}
SELECT code, 'selectable needs a verified pack' AS fault FROM catalog WHERE cloud_selectable AND rule_pack <> 'verified'
UNION ALL SELECT code, 'base language must be selectable' FROM catalog WHERE cloud_base AND NOT cloud_selectable
UNION ALL SELECT code, 'base language must be en' FROM catalog WHERE cloud_base AND code <> 'en'
UNION ALL SELECT NULL, 'exactly one base language' WHERE (SELECT count(*) FROM catalog WHERE cloud_base) <> 1""")
def catalog_faults(spark, sf):
    return registry.check_language_catalog(catalog(spark, sf))


@query("s4_model_registry", f"""WITH {MODELS_SQL} SELECT model_id, string_agg(language, ',' ORDER BY language) AS languages FROM heard GROUP BY model_id""")
def model_registry(spark, sf):
    """A registry written as the operator's file, in pieces, and read back."""
    path = scratch_dir(spark, "model-registry")
    quoted = F.array_join(F.transform("languages", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    entry = F.concat(F.lit('[[models]]\nid = "'), "model_id", F.lit('"\nfamily = "ctc"\nlanguages = ['), quoted, F.lit("]\n"))
    head = spark.range(1).select(F.lit("schema = 1\n").alias("value"))
    # Names of pieces begin with their place.
    head.coalesce(1).write.text(f"{path}/piece=0")
    _models(spark, sf).select(entry.alias("value")).write.text(f"{path}/piece=1")
    models = registry.read_model_registry(spark, path)
    return models.select("model_id", F.array_join("languages", ",").alias("languages"))


# A tokens file per fifty customers: each is a server, some entries are faulty.
ENTRY_OF = """CASE c_custkey % 12 WHEN 0 THEN 'unknown_keys' WHEN 1 THEN 'invalid_plan' WHEN 2 THEN 'invalid_languages' WHEN 3 THEN 'invalid_rate_limit'
  WHEN 4 THEN 'invalid_expiry' WHEN 5 THEN 'invalid_token' WHEN 6 THEN 'duplicate_token' END"""


def _token_files(spark, sf):
    customers = inputs.table(spark, sf, "customer").withColumn("fault", F.expr(ENTRY_OF))
    entry = F.expr("""CASE WHEN c_custkey % 12 = 7 THEN concat('"tok-', c_custkey, '"') ELSE concat('{"token": "',
      CASE fault WHEN 'invalid_token' THEN '' WHEN 'duplicate_token' THEN 'same' ELSE concat('tok-', c_custkey) END, '"',
      CASE fault WHEN 'unknown_keys' THEN ', "color": 1' WHEN 'invalid_plan' THEN ', "plan": "Big Plan"' WHEN 'invalid_languages' THEN ', "languages": []'
        WHEN 'invalid_rate_limit' THEN ', "rate-limit-per-minute": "5"' WHEN 'invalid_expiry' THEN ', "expires": "soon"'
        ELSE ', "languages": ["fr", "en"], "rate-limit-per-minute": 60, "expires": "2026-01-01T00:00:00+02:00"' END, '}') END""")
    named = customers.select(
        F.expr("concat('file-', c_custkey DIV 50)").alias("source_path"),
        F.concat(F.lit('"srv-'), "c_custkey", F.lit('": '), entry).alias("pair"),
    )
    # A tokens file is one object, so its fifty entries are gathered to write one.
    return named.groupBy("source_path").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list("pair"), ", "), F.lit("}")).alias("value")
    )


@query("s5_credentials", f"""WITH c AS (SELECT *, {ENTRY_OF} AS fault FROM customer),
plain AS (SELECT *, c_custkey % 12 = 7 AS bare FROM c WHERE fault IS NULL
  OR (fault = 'duplicate_token' AND c_custkey // 50 IN (SELECT c_custkey // 50 FROM c WHERE fault = 'duplicate_token' GROUP BY ALL HAVING count(*) = 1)))
SELECT concat('srv-', c_custkey) AS server_id, upper(sha256(CASE WHEN fault IS NULL THEN concat('tok-', c_custkey) ELSE 'same' END)) AS digest, 'selfhost' AS plan,
  CASE WHEN NOT bare THEN 'en,fr' END AS languages, CASE WHEN NOT bare THEN 60 END AS rate_limit_per_minute,
  CASE WHEN NOT bare THEN epoch_us(TIMESTAMP '2025-12-31 22:00:00') END AS expires_us FROM plain""")
def credentials(spark, sf):
    read, _ = registry.parse_credentials(_token_files(spark, sf))
    return read.select(
        "server_id", F.hex("token_digest").alias("digest"), "plan", F.array_join("languages", ",").alias("languages"),
        "rate_limit_per_minute", F.unix_micros("expires_at").alias("expires_us"),
    )


@query("s5_credential_rejects", f"""WITH c AS (SELECT *, {ENTRY_OF} AS fault FROM customer)
SELECT concat('file-', c_custkey // 50) AS source_path, concat('srv-', c_custkey) AS server_id, fault AS code FROM c
WHERE fault IS NOT NULL AND NOT (fault = 'duplicate_token' AND c_custkey // 50 IN
  (SELECT c_custkey // 50 FROM c WHERE fault = 'duplicate_token' GROUP BY ALL HAVING count(*) = 1))""")
def credential_rejects(spark, sf):
    return registry.parse_credentials(_token_files(spark, sf))[1]
