"""Rule packs: YAML files in, validated tables out.

A file may hold at most MAX_RULES rules of 1 + MAX_VARIANTS patterns; of files there may
be any number, so their tables are written out and never gathered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
import re
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot import domains, schemas
from earshot.functions import text as tx
from earshot.functions.literals import required_literals
from earshot.plans.sizing import materialize

# Packs are written for this module: the standard one reads some of their patterns otherwise.
import regex as _re

# The C parser reads the same YAML, some ten times faster.
_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
_LANGUAGE = re.compile(domains.PACK_LANGUAGE)
_RULE_ID = re.compile(domains.RULE_ID)


class PackFault(ValueError):
    """A pack is refused; code is stable, detail names the offending text if any."""

    def __init__(self, code: str, rule_id: str | None = None, detail: str | None = None):
        self.code, self.rule_id, self.detail = code, rule_id, detail
        super().__init__(code if detail is None else f"{code}:{detail}")


def compile_rule_regex(pattern: str):
    """Case-insensitive with full folding, the way pack authors write them."""
    return _re.compile(pattern, _re.VERSION1 | _re.IGNORECASE | _re.FULLCASE)


def jvm_prefilter(pattern: str) -> str | None:
    """A JVM regex that every match of pattern also satisfies, or null if unsure.

    Only plain groups of ASCII letters, digits and spaces are carried over. Word
    boundaries are dropped, which can only let more texts through, and dotless i is
    folded by the caller since the rule engine takes it for an i.
    """
    loose = pattern.replace(r"\b", "").lower()
    if re.fullmatch(r"(?:[a-z0-9 |)]|\((?:\?:)?|(?<=[a-z0-9)])[?+*])+", loose) is None:
        return None
    try:
        return loose if re.compile(loose).search("") is None else None
    except re.error:
        return None


def _short_text(value: Any) -> bool:
    return isinstance(value, str) and 0 < len(value) <= domains.MAX_PATTERN_CHARS


# Each rule field: the fault it raises, and what a valid value looks like.
_RULE_FIELDS: tuple[tuple[str, Callable[[dict], bool]], ...] = (
    ("invalid_rule_id", lambda r: isinstance(r.get("id"), str) and bool(_RULE_ID.fullmatch(r["id"]))),
    ("invalid_category", lambda r: _member(r.get("category"), domains.CATEGORIES)),
    ("invalid_severity", lambda r: _member(r.get("severity"), domains.SEVERITIES)),
    ("invalid_match_type", lambda r: _member(r.get("match"), domains.MATCH_TYPES)),
    ("invalid_term", lambda r: _short_text(r.get("term"))),
    (
        "invalid_variants",
        lambda r: isinstance(r.get("variants", []), list)
        and len(r.get("variants", [])) <= domains.MAX_VARIANTS
        and all(map(_short_text, r.get("variants", []))),
    ),
    ("invalid_context_required", lambda r: isinstance(r.get("context_required", False), bool)),
)


def _member(value: Any, allowed: tuple) -> bool:
    # True and 1 compare equal, and a list is not hashable: test the type first.
    return type(value) is not bool and isinstance(value, (str, int, float)) and value in allowed


def _regex_fault(rule: dict, sources: list[str]) -> PackFault | None:
    compiled = []
    for source in sources:
        try:
            compiled.append(compile_rule_regex(source))
        except Exception:
            return PackFault("invalid_regex", rule["id"])
        if compiled[-1].search("") is not None:
            return PackFault("empty_regex", rule["id"])
    probe = rule.get("probe")
    if not isinstance(probe, str) or not probe:
        return PackFault("regex_rule_needs_probe", rule["id"])
    spoken = tx.normalize_text(probe)
    if not spoken:
        return PackFault("regex_probe_normalises_to_nothing", rule["id"])
    if not any(c.search(spoken) for c in compiled):
        return PackFault("regex_probe_does_not_match", rule["id"], spoken)
    return None


def _fuzzy_fault(rule: dict, patterns: list[str]) -> PackFault | None:
    for pattern in patterns:
        if " " in pattern:
            return PackFault("fuzzy_pattern_not_single_token", rule["id"], pattern)
        if len(pattern) < domains.FUZZY_MIN_CHARS:
            return PackFault("fuzzy_pattern_too_short", rule["id"], pattern)
    return None


def _read_rule(rule: Any) -> tuple[list[str], list[str]] | PackFault:
    """(patterns to match, patterns as written), or why the rule is refused."""
    if not isinstance(rule, dict):
        return PackFault("invalid_rule")
    rule_id = rule["id"] if isinstance(rule.get("id"), str) else None
    for code, valid in _RULE_FIELDS:
        if not valid(rule):
            return PackFault(code, rule_id)
    sources = [rule["term"], *rule.get("variants", [])]
    if rule["match"] == "regex":
        return _regex_fault(rule, sources) or (sources, sources)
    patterns = [tx.normalize_text(s) for s in sources]
    if not all(patterns):
        return PackFault("invalid_term", rule_id)
    if rule["match"] == "fuzzy" and (fault := _fuzzy_fault(rule, patterns)):
        return fault
    return patterns, sources


def _read_allow(document: dict) -> list[str]:
    terms = document.get("allow", [])
    if not isinstance(terms, list) or len(terms) > domains.MAX_ALLOW_TERMS:
        raise PackFault("invalid_allow")
    if not all(map(_short_text, terms)) or not all(spoken := [tx.normalize_text(t) for t in terms]):
        raise PackFault("invalid_allow")
    return spoken


def read_pack(content: bytes) -> tuple[dict, list[PackFault]]:
    """One pack file as a dict of table rows, with all its faults in checking order."""
    try:
        document = yaml.load(content.decode("utf-8"), Loader=_LOADER)
    except (UnicodeDecodeError, yaml.YAMLError):
        return {}, [PackFault("invalid_yaml")]
    if not isinstance(document, dict) or document.get("version") != 1:
        return {}, [PackFault("invalid_pack")]
    language, rules = document.get("language"), document.get("rules")
    if not isinstance(language, str) or not _LANGUAGE.fullmatch(language):
        return {}, [PackFault("invalid_language")]
    pack: dict = {"language": language, "rules": [], "patterns": [], "allow": []}
    if not isinstance(rules, list) or not 0 < len(rules) <= domains.MAX_RULES:
        return pack, [PackFault("invalid_rules")]

    faults: list[PackFault] = []
    seen: set[str] = set()
    for rule_ord, rule in enumerate(rules):
        outcome = _read_rule(rule)
        if not isinstance(outcome, PackFault) and rule["id"] in seen:
            outcome = PackFault("duplicate_rule_id", rule["id"])
        if isinstance(outcome, PackFault):
            faults.append(outcome)
            continue
        seen.add(rule["id"])
        pack["rules"].append(
            (rule_ord, rule["id"], rule["category"], int(rule["severity"]), rule["match"],
             rule.get("context_required", False))
        )
        for pattern_ord, (pattern, source) in enumerate(zip(*outcome)):
            pack["patterns"].append((rule_ord, rule["id"], rule["match"], pattern_ord, pattern, source))
    try:
        pack["allow"] = _read_allow(document)
    except PackFault as fault:
        faults.append(fault)
    # An allow term equal to a listed pattern would silence that pattern for good.
    shadowed = {row[4] for row in pack["patterns"]} & set(pack["allow"])
    if shadowed:
        faults.append(PackFault("allow_shadows_rule", None, min(shadowed)))
    return pack, faults


_PARSED = (
    "source_path string, entry string, language string, rule_ord int, rule_id string, "
    "category string, severity int, match_type string, context_required boolean, ord int, "
    "pattern string, source_pattern string, prefilter string, literals array<array<string>>, "
    "code string, detail string"
)
#: Parsed rows that a task holds, besides those of one file.
PARSED_ROWS = 4096
_PARSED_COLUMNS = [tuple(field.split()) for field in _PARSED.split(", ")]
_ARROW = {
    "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(),
    "array<array<string>>": pa.list_(pa.list_(pa.string())),
}


def _parsed_rows(path: str, content: bytes) -> Iterator[dict]:
    pack, faults = read_pack(bytes(content))
    language = pack.get("language")
    for i, fault in enumerate(faults):
        yield {"source_path": path, "entry": "fault", "language": language, "ord": i,
               "rule_id": fault.rule_id, "code": fault.code, "detail": fault.detail}
    if faults:
        return
    for rule_ord, rule_id, category, severity, match_type, context in pack["rules"]:
        yield {"source_path": path, "entry": "rule", "language": language, "rule_ord": rule_ord,
               "rule_id": rule_id, "category": category, "severity": severity,
               "match_type": match_type, "context_required": context}
    for rule_ord, rule_id, match_type, pattern_ord, pattern, source in pack["patterns"]:
        yield {"source_path": path, "entry": "pattern", "language": language, "rule_ord": rule_ord,
               "rule_id": rule_id, "match_type": match_type, "ord": pattern_ord,
               "pattern": pattern, "source_pattern": source,
               "prefilter": jvm_prefilter(source) if match_type == "regex" else None,
               "literals": _literals(match_type, pattern)}
    for allow_ord, term in enumerate(pack["allow"]):
        yield {"source_path": path, "entry": "allow", "language": language, "ord": allow_ord,
               "pattern": term}


def _literals(match_type: str, pattern: str) -> list[list[str]] | None:
    """What a text must hold to have this pattern: one literal of each list."""
    if match_type == "contains":
        return [[pattern]]
    return required_literals(pattern) if match_type == "regex" else None


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in _PARSED_COLUMNS])
    rows: list[dict] = []
    for batch in batches:
        for path, content in zip(batch["source_path"], batch["content"]):
            rows += _parsed_rows(path.as_py(), content.as_py())
            # A batch may be of a thousand files: rows leave before they are many.
            if len(rows) >= PARSED_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parse_packs(files: DataFrame) -> DataFrame:
    """(source_path, content BINARY), one row per file, to parsed entries and faults."""
    return files.select("source_path", F.col("content").cast("binary").alias("content")).mapInArrow(
        _parse_batches, _PARSED
    )


@dataclass(frozen=True)
class RulePacks:
    """Pack tables, and what the driver knows about them without a job.

    languages is in file order, which is also the order "auto" runs them in.
    """

    rules: DataFrame
    patterns: DataFrame
    allow_terms: DataFrame
    rejects: DataFrame
    languages: tuple[str, ...]
    match_types: dict[str, tuple[str, ...]]
    n_patterns: int
    n_allow: int
    allow_languages: tuple[str, ...] = ()
    #: How many patterns of each language are looked for in whole texts, not in tokens.
    n_whole: dict[str, int] = field(default_factory=dict)

    def of_type(self, match_type: str) -> tuple[str, ...]:
        """Languages that have rules of this match type."""
        return self.match_types.get(match_type, ())

    def with_types(self, *kinds: str) -> RulePacks:
        """The same packs with only the rules of these match types."""
        chosen = F.col("match_type").isin(*kinds)
        return replace(
            self, rules=self.rules.filter(chosen), patterns=self.patterns.filter(chosen),
            match_types={k: v for k, v in self.match_types.items() if k in kinds},
        )

    def without_allow(self) -> RulePacks:
        return replace(self, allow_terms=self.allow_terms.filter("false"), n_allow=0, allow_languages=())


def pack_tables(parsed: DataFrame, order: DataFrame) -> tuple[DataFrame, ...]:
    """Typed rules, patterns, allow terms and rejects from parsed entries.

    order maps source_path to pack_ord.
    """
    entries = parsed.join(order, "source_path")
    rules = entries.filter("entry = 'rule'").select(
        "language", F.col("pack_ord").cast("int"), "rule_ord", "rule_id", "category", "severity",
        "match_type", "context_required",
    )
    pattern = F.col("pattern")
    fuzzy = F.col("match_type") == "fuzzy"
    patterns = entries.filter("entry = 'pattern'").select(
        "language", "rule_id", "rule_ord", "match_type", F.col("ord").alias("pattern_ord"),
        "pattern", "source_pattern", "prefilter", "literals",
        F.size(tx.tokens(pattern)).alias("n_tokens"),
        F.length(pattern).alias("n_chars"),
        F.when(fuzzy, tx.run_chars(pattern)).alias("run_chars"),
        F.when(fuzzy, tx.run_lengths(pattern)).alias("run_lens"),
        F.when(fuzzy, tx.skeleton(pattern)).alias("skeleton"),
    )
    allow_terms = entries.filter("entry = 'allow'").select(
        "language", F.col("ord").alias("allow_ord"), pattern.alias("term"),
        F.size(tx.tokens(pattern)).alias("n_tokens"),
    )
    rejects = parsed.filter("entry = 'fault'").select(
        "source_path", "language", F.col("ord").alias("fault_ord"), "rule_id", "code", "detail"
    )
    return rules, patterns, allow_terms, rejects


def file_order(files: DataFrame) -> DataFrame:
    """Files in name order. One row per pack file, so a global window is small."""
    return files.select(
        "source_path",
        (F.row_number().over(Window.orderBy("source_path")) - 1).alias("pack_ord"),
    )


def packs_from_files(files: DataFrame, mode: str = "failfast") -> RulePacks:
    """RulePacks from (source_path, content) rows.

    mode "failfast" raises the first fault in file order; "report" drops the refused
    files and lists their faults in rejects. Both insist on one pack per language and
    on at least one pack. The tables are written out and stay distributed; the driver
    learns each pack's language, kinds of rules and counts.
    """
    if mode not in ("failfast", "report"):
        raise ValueError(f"unknown mode: {mode}")
    files = files.select("source_path", "content")
    parsed = materialize(parse_packs(files), "parsed-packs")
    order = file_order(files.select("source_path"))
    rules, patterns, allow_terms, rejects = (
        df.select(*schema.fieldNames())
        for df, schema in zip(
            pack_tables(parsed, order), (schemas.RULES, schemas.PATTERNS, schemas.ALLOW_TERMS, schemas.PACK_REJECTS)
        )
    )
    if mode == "failfast":
        for first in rejects.orderBy("source_path", "fault_ord").limit(1).collect():
            raise PackFault(first["code"], first["rule_id"], first["detail"])
    rules, patterns = materialize(rules, "rules"), materialize(patterns, "patterns")
    allow_terms = materialize(allow_terms, "allow-terms")
    kinds = rules.groupBy("pack_ord", "language").agg(F.sort_array(F.collect_set("match_type")).alias("kinds")).orderBy("pack_ord").collect()
    in_order = [r["language"] for r in kinds]
    repeated = [language for language, n in Counter(in_order).items() if n > 1]
    if repeated:
        raise ValueError(f"duplicate rule language: {repeated[0]}")
    if not in_order:
        raise ValueError("no rule packs")
    by_type = {kind: tuple(r["language"] for r in kinds if kind in r["kinds"]) for kind in {k for r in kinds for k in r["kinds"]}}
    allowing = allow_terms.groupBy("language").count().collect()
    whole = F.col("match_type").isin("contains", "regex")
    # A row per language.
    counted = patterns.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("whole")).collect()
    return RulePacks(
        rules, patterns, allow_terms, rejects, tuple(in_order), by_type, sum(r["n"] for r in counted),
        sum(r["count"] for r in allowing), tuple(sorted(r["language"] for r in allowing)),
        {r["language"]: r["whole"] for r in counted if r["whole"]},
    )


def read_pack_files(spark: SparkSession, path: str) -> DataFrame:
    """Every *.yml directly in a directory, as (source_path, content)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.yml")
        .load(path)
        .select(F.col("path").alias("source_path"), "content")
    )


def read_packs(spark: SparkSession, path: str, mode: str = "failfast") -> RulePacks:
    return packs_from_files(read_pack_files(spark, path), mode)
