"""From matches to verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import domains

# A scorer takes (transcript, language) columns and gives a schemas.TOXICITY struct, or
# null for clean speech. It is usually a pandas UDF over a model.
Classifier = Callable[[Column, Column], Column]


def acting_severity(severity: str = "severity", review: str = "context_required") -> Column:
    """Aggregate: the highest severity outside the review tier, else 0."""
    return F.coalesce(F.max(F.when(~F.col(review), F.col(severity))), F.lit(0))


def gather_matches(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per text that broke a rule, its matches in reporting order."""
    report = F.struct("rule_id", "category", "severity", "matched_text", "context_required")
    ordered = F.array_sort(
        F.collect_list(F.struct("pack_ord", "pass", "rule_ord", report.alias("match")))
    )
    return matches.groupBy(*keys).agg(
        F.transform(ordered, lambda m: m["match"]).alias("rule_matches"),
        acting_severity().alias("rule_severity"),
    )


def checked_toxicity(result: Column) -> Column:
    """The scorer's result, or an error when it leaves the agreed domain."""
    sound = (
        result["category"].isin(*domains.CATEGORIES)
        & result["severity"].isin(*domains.SEVERITIES)
        & result["confidence"].between(0.0, 1.0)
    )
    failure = F.raise_error(F.lit("invalid toxicity classifier result"))
    return F.when(result.isNull(), result).when(F.coalesce(sound, F.lit(False)), result).otherwise(failure)


def verdicts(
    texts: DataFrame, matches: DataFrame, keys: Sequence[str], text: str = "norm",
    language: str = "verdict_language", classifier: Classifier | None = None,
) -> DataFrame:
    """A verdict for every text, clean ones included.

    The texts are shuffled by key at most once: not at all when they are bucketed by it,
    or when at run time the matches turn out small enough to be broadcast. No join is
    forced, since how dense matches are is for the run to find out.
    """
    gathered = gather_matches(matches, keys)
    joined = texts.join(gathered, list(keys), "left").select(
        texts["*"],
        F.coalesce("rule_matches", F.array().cast(gathered.schema["rule_matches"].dataType)).alias("rule_matches"),
        F.coalesce("rule_severity", F.lit(0)).alias("rule_severity"),
    )
    rule_confidence = (F.size("rule_matches") > 0).cast("double")
    if classifier is None:
        found, severity, confidence = F.col("rule_matches"), F.col("rule_severity"), rule_confidence
    else:
        joined = joined.withColumn(
            "toxicity", checked_toxicity(classifier(F.col(text), F.coalesce(language, F.lit("auto"))))
        )
        scored = F.struct(
            F.lit(domains.CLASSIFIER_RULE_ID).alias("rule_id"),
            F.col("toxicity.category").alias("category"),
            F.col("toxicity.severity").alias("severity"),
            F.col("toxicity.matched_text").alias("matched_text"),
            F.lit(False).alias("context_required"),
        )
        flagged = F.col("toxicity").isNotNull()
        found = F.when(flagged, F.concat("rule_matches", F.array(scored))).otherwise(F.col("rule_matches"))
        severity = F.greatest("rule_severity", F.coalesce("toxicity.severity", F.lit(0)))
        confidence = F.greatest(rule_confidence, F.coalesce("toxicity.confidence", F.lit(0.0)))
    carried = [c for c in texts.columns if c not in (text, language)]
    return joined.select(
        *carried,
        F.col(text).alias("transcript"),
        F.coalesce(language, F.lit("auto")).alias("language"),
        found.alias("matches"),
        F.size(found).alias("n_matches"),
        severity.alias("severity"),
        confidence.alias("confidence"),
    )

