"""What people set by hand: term relations and settings, checked before they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import normalize_text, term_key

#: The kinds of relation, and each setting's type, range and scopes.
RELATION_TYPES = ("synonym", "alias", "abbreviation", "related", "contextual_equivalent", "location_mapping", "product_name", "ambiguous")
SETTINGS = {
    "capture.paused": ("boolean", None, None),
    "recall.max_snippets": ("integer", 1, 100),
    "recall.max_characters": ("integer", 1, 100_000),
    "recall.max_files": ("integer", 1, 50_000),
    "recall.max_raw_fragment_characters": ("integer", 1, 5_000),
    "recall.timeout_ms": ("integer", 0, 30_000),
    "staleness.warning_enabled": ("boolean", None, None),
    "staleness.threshold_days": ("integer", 1, 3_650),
    "embedding.desired_enabled": ("boolean", None, None),
    "embedding.semantic_weight": ("number", 0, 1),
}


def _json(values: Column) -> Column:
    return F.to_json(values)


def term_relations(proposed: DataFrame) -> DataFrame:
    """``proposed`` (project_id, term_a, term_b, relation_type, confidence, context_tags) as relations: terms in order,
    an id that is the same for the same pair and context, and ``fault``: why a relation may not be set, or null."""
    norm = lambda c: F.coalesce(normalize_text(F.lower(c)), F.lit(""))
    terms = F.array_sort(F.array(norm(F.col("term_a")), norm(F.col("term_b"))))
    keys = F.array_sort(F.transform(terms, term_key))
    context = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("context_tags", F.array().cast("array<string>")), norm), lambda v: v != "")))
    rows = proposed.withColumn("terms", terms).withColumn("keys", keys).withColumn("context", context)
    fault = F.when(F.exists("terms", lambda t: (F.length(t) < 1) | (F.length(t) > 128)) | (F.col("keys")[0] == F.col("keys")[1]), "terms")
    fault = fault.when((F.col("relation_type") == "contextual_equivalent") & (F.size("context") == 0), "context")
    fault = fault.when(~F.coalesce(F.col("relation_type").isin(*RELATION_TYPES), F.lit(False)), "type").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
    text = F.concat(F.lit("["), _json(F.col("keys")), F.lit(","), _json(F.col("context")), F.lit("]"))
    return rows.select("project_id", F.concat(F.lit("tr_"), F.substring(F.sha2(text, 256), 1, 24)).alias("relation_id"), F.col("terms")[0].alias("term_a"), F.col("terms")[1].alias("term_b"), "relation_type", "confidence", "context", fault.alias("fault"))


def set_relations(current: DataFrame, proposed: DataFrame, now: str) -> DataFrame:
    """The relations after ``proposed`` ones without a fault replace those of the same id, whose creation they keep."""
    new = term_relations(proposed).where("fault IS NULL").drop("fault").dropDuplicates(["project_id", "relation_id"])
    before = current.select("project_id", "relation_id", F.col("created_at").alias("before"))
    written = new.join(before, ["project_id", "relation_id"], "left").withColumn("created_at", F.coalesce("before", F.lit(now))).withColumn("last_verified", F.lit(now)).drop("before")
    return current.join(new, ["project_id", "relation_id"], "left_anti").unionByName(written, allowMissingColumns=True)


def checked_settings(rows: DataFrame) -> DataFrame:
    """``rows`` (key, raw) with the parsed ``value`` as text and ``valid``: of its type and range. Unknown keys are not."""
    raw, number = F.col("raw"), F.expr("try_cast(trim(raw) AS double)")
    valid, value = F.lit(False), F.lit(None).cast("string")
    for key, (kind, low, high) in SETTINGS.items():
        mine = F.col("key") == key
        if kind == "boolean":
            ok, shown = raw.isin("true", "false"), raw
        else:
            ok = number.between(low, high) & ~F.isnan(number)
            if kind == "integer":
                ok = ok & (number == F.floor(number))
            shown = number.cast("string")
        valid = F.when(mine, F.coalesce(ok, F.lit(False))).otherwise(valid)
        value = F.when(mine, shown).otherwise(value)
    return rows.select("key", "raw", F.when(valid, value).alias("value"), valid.alias("valid"))
