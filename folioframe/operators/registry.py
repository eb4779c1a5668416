"""Model and field registries: search, aliases, versions, review and upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.plans.spatial import PAGE


def field_search(field: DataFrame, query: str = "", status: str | None = None) -> DataFrame:
    """Status filter and case-insensitive substring over the id, label and key columns."""
    found = field
    if status == "CONFIRMED":
        found = found.where((F.col("calibration_status") == "CONFIRMED") | (
            F.col("calibration_status").isNull() & (F.col("derivation") == "MANUAL_VERIFIED")))
    elif status:
        found = found.where(F.col("calibration_status") == status)
    if query.strip():
        wanted = F.lit(query.lower())
        columns = [c for c in ("field_id", "label", "semantic_key", "anchor_text", "suggested_label", "suggested_key") if c in field.columns]
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted), F.lit(False))
        found = found.where(hit)
    return found


def section_search(section: DataFrame, field: DataFrame, query: str) -> DataFrame:
    """Sections whose title, or any of whose field labels, contains the query."""
    wanted = F.lit(query.lower())
    by_label = field.where(F.lower("label").contains(wanted)).select("section_id").distinct().withColumn("_hit", F.lit(True))
    joined = section.join(by_label, "section_id", "left")
    return joined.where(F.lower("title").contains(wanted) | F.col("_hit")).drop("_hit")


def applicable_sections(section: DataFrame, model: str | int) -> DataFrame:
    return section.where(F.array_contains("applicable_models", model))


def resolve_alias(key: DataFrame, alias: DataFrame, entry: DataFrame) -> DataFrame:
    """Legacy key to canonical key to catalogue entry, left outer."""
    canonical = key.join(alias.select(F.col("alias").alias("key"), "canonical_key"), "key", "left").withColumn(
        "canonical_key", F.coalesce("canonical_key", "key"))
    return canonical.join(entry.withColumnRenamed("key", "canonical_key"), "canonical_key", "left")


def resolve_model(request: DataFrame, custom: DataFrame, builtin: DataFrame, alias: DataFrame,
                  custom_prefixes: Sequence[str] = ("tpl_", "custom_", "model_custom", "model_demo")) -> DataFrame:
    """Custom id first, then built-in id, then alias; custom prefixes never reach a built-in by alias."""
    c = custom.select(F.col("model_id").alias("identifier"), F.col("model_id").alias("_c")).dropDuplicates(["identifier"])
    b = builtin.select(F.col("model_id").alias("identifier"), F.col("model_id").alias("_b")).dropDuplicates(["identifier"])
    a = alias.select(F.upper("alias").alias("_u"), F.col("model_id").alias("_a")).dropDuplicates(["_u"])
    reserved = F.lit(False)
    for prefix in custom_prefixes:
        reserved = reserved | F.col("identifier").startswith(prefix)
    joined = request.join(c, "identifier", "left").join(b, "identifier", "left").withColumn(
        "_u", F.when(~reserved, F.upper(F.trim("identifier")))).join(a, "_u", "left")
    return joined.select(
        *request.columns, F.coalesce("_c", "_b", "_a").alias("model_id"),
        F.when(F.col("_c").isNotNull(), "custom").when(F.col("_b").isNotNull(), "builtin").when(F.col("_a").isNotNull(), "alias").alias("resolved_by"))


def removable_binaries(removed: DataFrame, template: DataFrame, document: DataFrame) -> DataFrame:
    """Binaries of removed templates that no other template and no saved document still uses."""
    left = template.join(removed.select("template_id"), "template_id", "left_anti")
    used = left.select("sha256").unionByName(document.select("sha256")).distinct()
    gone = template.join(removed.select("template_id"), "template_id", "left_semi")
    return gone.join(used, "sha256", "left_anti").select("template_id", "sha256")


def versions_of(registry: DataFrame, name: str) -> DataFrame:
    """Members of a family (substring of order, name or id), newest year first."""
    wanted = F.lit(name.lower())
    family = registry.where(F.lower("school_order").contains(wanted) | F.lower("name").contains(wanted)
                            | F.lower(F.col("template_id").cast("string")).contains(wanted))
    year = F.coalesce(F.expr("try_cast(regexp_replace(cast(validity_year AS string), '[^0-9]', '') AS int)"), F.lit(0))
    return family.withColumn("year", year).withColumn(
        "position", F.row_number().over(Window.partitionBy("school_order").orderBy(F.desc("year"), "template_id")))


def model_catalogue(builtin: DataFrame, custom: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """Active models in two groups; the default is the preferred one if it is active, never guessed."""
    rows = builtin.withColumn("group", F.lit("builtin")).unionByName(custom.withColumn("group", F.lit("other"))).where(F.col("status") == "active")
    if preferred is None:
        return rows.withColumn("is_default", F.lit(False))
    wanted = preferred.select(F.col("template_id"), F.lit(True).alias("_d")).distinct()
    return rows.join(wanted, "template_id", "left").withColumn("is_default", F.coalesce("_d", F.lit(False))).drop("_d")


def sync_stored_geometry(stored: DataFrame, schema: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Schema values win over stored ones; stored-only columns and stored-only fields are kept."""
    keys = [*by, "field_id"]
    shared = [c for c in schema.columns if c not in keys]
    s = schema.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in shared], F.lit(True).alias("_in_schema"))
    joined = stored.join(s, keys, "full_outer")
    known = F.coalesce("_in_schema", F.lit(False))
    value = lambda c: F.when(known, F.col(f"_s_{c}")).otherwise(F.col(c)) if c in stored.columns else F.col(f"_s_{c}")
    rest = [c for c in stored.columns if c not in keys and c not in shared]
    return joined.select(*keys, *[value(c).alias(c) for c in shared], *rest, known.alias("from_schema"))


def apply_review(field: DataFrame, page_or_field: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Confirm proposed fields in bulk (all, or those listed) and mark the ones left unassigned."""
    chosen = field.withColumn("_r", F.lit(True)) if page_or_field is None else field.join(
        page_or_field.select(*on).distinct().withColumn("_r", F.lit(True)), list(on), "left")
    hit = F.coalesce("_r", F.lit(False)) & (F.col("calibration_status") == "PROPOSED")
    status = F.when(hit, F.when(F.coalesce("modified", F.lit(False)), "MODIFIED").otherwise("CONFIRMED")).otherwise(F.col("calibration_status"))
    reviewed = chosen.withColumn("_hit", hit).withColumns({
        "calibration_status": status, "status": F.when(hit, "MAPPED").otherwise(F.col("status")),
        "derivation": F.when(hit, "MANUAL_VERIFIED").otherwise(F.col("derivation"))})
    return reviewed.withColumn("unassigned", (F.col("status") == "MAPPED") & F.col("semantic_key").isNull()
                               & (F.coalesce("calibration_status", F.lit("")) != "REJECTED")).drop("_r", "_hit")
