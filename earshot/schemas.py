"""Every table's schema, in one place."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

S, I, L, B, D, TS = (
    StringType(),
    IntegerType(),
    LongType(),
    BooleanType(),
    DoubleType(),
    TimestampType(),
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


RULES = _struct(
    language=S,
    pack_ord=I,
    rule_ord=I,
    rule_id=S,
    category=S,
    severity=I,
    match_type=S,
    context_required=B,
)
PATTERNS = _struct(
    language=S,
    rule_id=S,
    rule_ord=I,
    match_type=S,
    pattern_ord=I,
    pattern=S,
    source_pattern=S,
    prefilter=S,
    literals=ArrayType(ArrayType(S)),
    n_tokens=I,
    n_chars=I,
    run_chars=ArrayType(S),
    run_lens=ArrayType(I),
    skeleton=S,
)
ALLOW_TERMS = _struct(language=S, allow_ord=I, term=S, n_tokens=I)
PACK_REJECTS = _struct(
    source_path=S, language=S, fault_ord=I, rule_id=S, code=S, detail=S
)

UTTERANCES = _struct(
    request_id=S,
    tenant_key=S,
    server_id=S,
    player_id=S,
    occurred_at=TS,
    language_spec=S,
    detected_language=S,
    text=S,
    partial=B,
    samples_16k=L,
)
# What a sender actually puts on a request; the checks turn it into UTTERANCES.
REQUESTS = _struct(
    request_id=S,
    token_digest=BinaryType(),
    player_id=S,
    occurred_at=TS,
    language_spec=S,
    preroll=S,
    partial_flag=S,
    detected_language=S,
    text=S,
    samples_16k=L,
)
MATCH = _struct(
    rule_id=S, category=S, severity=I, matched_text=S, context_required=B
)
VERDICTS = _struct(
    request_id=S,
    transcript=S,
    language=S,
    matches=ArrayType(MATCH),
    n_matches=I,
    severity=I,
    confidence=D,
)
CREDENTIALS = _struct(
    server_id=S,
    token_digest=BinaryType(),
    tenant_key=S,
    plan=S,
    languages=ArrayType(S),
    rate_limit_per_minute=I,
    expires_at=TS,
)
CREDENTIAL_REJECTS = _struct(source_path=S, server_id=S, code=S)
LANGUAGE_CATALOG = _struct(
    code=S,
    name=S,
    cloud_base=B,
    cloud_selectable=B,
    models=ArrayType(S),
    rule_pack=S,
    evidence=S,
)
MODELS = _struct(model_id=S, family=S, languages=ArrayType(S))
USAGE = _struct(
    tenant_key=S,
    server_id=S,
    requests=L,
    flagged=L,
    outcomes=MapType(S, L),
    severities=MapType(I, L),
    audio_seconds=L,
)
FLAGGED_EVENTS = _struct(
    tenant_key=S,
    server_id=S,
    request_id=S,
    player_uuid=S,
    occurred_at=TS,
    rule_id=S,
    category=S,
    severity=I,
    rule_count=I,
    matched_text=S,
    transcript=S,
)
TRACES = _struct(
    request_id=S,
    outcome=S,
    total_ms=I,
    decode_ms=I,
    stt_ms=I,
    rules_ms=I,
    classifier_ms=I,
    serialize_ms=I,
)
TOXICITY = _struct(
    category=S, severity=I, confidence=D, matched_text=S, language=S
)
