"""Two inventories of the same things: differences, links, specification checks, findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from opswell.functions import text as X
from opswell.operators.tables import newest, oldest, top_sample

# The tag key that binds a record to its service, and keys that were used before it. Fixed values.
CANONICAL_TAG = "servicenow.com/service-instance"
ALTERNATE_TAGS = ["app.kubernetes.io/name", "service-instance"]


def diff(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_order: Sequence[str],
    right_order: Sequence[str],
    names: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """Rows of two tables side by side by key, with status matched, <left>_only or <right>_only.

    Of several left rows with one key the last counts, of several right rows the
    first. Both choices are aggregates, so copies shrink before they are moved.
    """
    left = newest(left.where(X.filled(key)), [key], left_order)
    right = oldest(right.where(X.filled(key)), [key], right_order)
    a = left.select(F.col(key).alias("_left_key"), *[F.col(c).alias(f"{names[0]}_{c}") for c in left.columns if c != key])
    b = right.select(F.col(key).alias("_right_key"), *[F.col(c).alias(f"{names[1]}_{c}") for c in right.columns if c != key])
    joined = a.join(b, F.col("_left_key") == F.col("_right_key"), "full_outer")
    status = (
        F.when(F.col("_right_key").isNull(), F.lit(f"{names[0]}_only"))
        .when(F.col("_left_key").isNull(), F.lit(f"{names[1]}_only"))
        .otherwise(F.lit("matched"))
    )
    return joined.select(
        F.coalesce("_left_key", "_right_key").alias(key),
        *[c for c in joined.columns if not c.startswith("_")],
        status.alias("status"),
    )


def through_map(df: DataFrame, column: str, names: DataFrame, source: str, target: str) -> DataFrame:
    """Replaces names by the map; names it does not know pass through."""
    mapping = names.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    return df.join(mapping, F.col(column) == F.col("_from"), "left").select(
        *[F.coalesce("_to", column).alias(column) if c == column else c for c in df.columns]
    )


def newest_links(links: DataFrame, entity: str, updated: str) -> DataFrame:
    """The newest link per entity; the entity is what follows the last separator of the link's id."""
    return newest(links.withColumn("entity", X.last_part(entity)), ["entity"], [updated])


def mapping_state(entities: DataFrame, entity: str, links: DataFrame, link_entity: str, keep: Sequence[str] = ()) -> DataFrame:
    """Entities without a link (missing), links without an entity (stale), and both (active)."""
    a = entities.select(F.col(entity).alias("_entity"), *keep).distinct()
    b = links.select(F.col(link_entity).alias("_link")).distinct()
    joined = a.join(b, F.col("_entity") == F.col("_link"), "full_outer")
    return joined.select(
        F.coalesce("_entity", "_link").alias("entity"),
        *keep,
        F.when(F.col("_link").isNull(), F.lit("missing"))
        .when(F.col("_entity").isNull(), F.lit("stale"))
        .otherwise(F.lit("active"))
        .alias("state"),
    )


def tag_counts(bindings: DataFrame, key: str, value: str) -> DataFrame:
    """Bindings per value with the canonical key and with one of the alternate keys."""
    named = bindings.where(X.filled(value))
    return named.groupBy(F.col(value).alias("value")).agg(
        F.count_if(F.col(key) == CANONICAL_TAG).alias("canonical"),
        F.count_if(F.col(key).isin(ALTERNATE_TAGS)).alias("alternate"),
    )


def tag_value(name: Column | str, platform: Column | str) -> Column:
    """Value the canonical tag should have: the name, in label characters where the platform wants labels."""
    return F.when(X.col(platform) == "kubernetes", X.label(name)).otherwise(X.col(name))


def service_status(spec: DataFrame, present: DataFrame, counts: DataFrame) -> DataFrame:
    """State of every specified service.

    spec: name, identifier, platform, service_mapping; present: name; counts: tag_counts.
    """
    found = present.select(F.col("name").alias("_present")).distinct()
    canonical = counts.select(F.col("value").alias("_tag"), "canonical")
    alternate = counts.select(F.col("value").alias("_identifier"), "alternate")
    rows = (
        spec.withColumn("_want", tag_value("name", "platform"))
        .join(found, F.col("name") == F.col("_present"), "left")
        .join(canonical, F.col("_want") == F.col("_tag"), "left")
        .join(alternate, F.col("identifier") == F.col("_identifier"), "left")
        .fillna(0, ["canonical", "alternate"])
    )
    by_tags = F.col("service_mapping") == "tags"
    status = (
        F.when(F.col("_present").isNull(), F.lit("missing_in_cmdb"))
        .when(by_tags & (F.col("canonical") > 0), F.lit("ok_canonical_tag"))
        .when(by_tags & (F.col("alternate") > 0), F.lit("ok_alternate_tag_only"))
        .when(by_tags, F.lit("missing_tag_binding"))
        .otherwise(F.lit("present_in_cmdb"))
    )
    return rows.select(
        *spec.columns, F.col("canonical").alias("canonical_tag_count"), F.col("alternate").alias("alternate_tag_count"), status.alias("status")
    )


def required_fields(items: DataFrame, key: str, fields: Sequence[str], given_is_enough: Sequence[str] = ()) -> DataFrame:
    """One row per item and required field that is missing or blank.

    For the fields in given_is_enough a blank text counts as declared.
    """
    checks = [
        F.when(F.col(f).isNull() if f in given_is_enough else ~X.filled(F.col(f).cast("string")), F.lit(f))
        for f in fields
    ]
    return items.select(key, F.explode(F.array_compact(F.array(*checks))).alias("field"))


def expected_entities(
    expected: DataFrame, name: str, entities: DataFrame, display: str, zones: str, zone: str
) -> DataFrame:
    """Expected entities that are not there, or are there but not in the zone."""
    there = oldest(entities.select(F.col(display).alias("_name"), "entity_id", zones), ["_name"], ["entity_id"])
    rows = expected.join(there, F.col(name) == F.col("_name"), "left")
    issue = F.when(F.col("_name").isNull(), F.lit("missing_entity")).when(
        ~F.coalesce(F.array_contains(zones, zone), F.lit(False)), F.lit("missing_management_zone")
    )
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").select(*expected.columns, "entity_id", "issue")


def zone_coverage(entities: DataFrame, zone: str) -> DataFrame:
    """One row: hosts and process groups in the zone, process groups at all, and whether that is a finding."""
    inside = F.coalesce(F.array_contains("zones", zone), F.lit(False))
    of = lambda kind: F.col("entity_type") == kind
    out = entities.agg(
        F.count_if(of("HOST") & inside).alias("hosts_in_zone"),
        F.count_if(of("PROCESS_GROUP") & inside).alias("groups_in_zone"),
        F.count_if(of("PROCESS_GROUP")).alias("groups"),
    )
    return out.withColumn("finding", (F.col("hosts_in_zone") > 0) & (F.col("groups_in_zone") == 0))


FINDING = ["category", "subcategory", "subclass", "severity"]


def findings_tree(findings: DataFrame, order: str, k: int = 50) -> DataFrame:
    """All items of every finding with their place, the finding's size, and whether they are among its first k."""
    return top_sample(findings, FINDING, [order], k)


def shown_items(tree: DataFrame, item: str) -> DataFrame:
    """One row per finding: its size, and the items that are shown as an array."""
    return tree.groupBy(*FINDING, F.col("of_total").alias("count")).agg(
        F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("sample_no", item)))).alias("items")
    )


def status_table(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def audit_relations(declared: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared relations against observed ones: confirmed, missing or undeclared."""
    a = declared.select(*keys).distinct().withColumn("_declared", F.lit(True))
    b = observed.select(*keys).distinct().withColumn("_observed", F.lit(True))
    return a.join(b, list(keys), "full_outer").select(
        *keys,
        F.when(F.col("_observed").isNull(), F.lit("missing"))
        .when(F.col("_declared").isNull(), F.lit("undeclared"))
        .otherwise(F.lit("confirmed"))
        .alias("audit"),
    )


def zones_by_rule(entities: DataFrame, rules: Sequence[tuple[str, str, str, str, str]]) -> DataFrame:
    """Entity and zone, one row per rule that holds.

    A rule is (entity_type, column, operator, value, zone) with operator equals or begins; case does not matter.
    """
    hits = []
    for kind, column, operator, value, zone in rules:
        here = F.lower(F.col(column))
        test = here == value.lower() if operator == "equals" else here.startswith(value.lower())
        hits.append(F.when((F.col("entity_type") == kind) & test, F.lit(zone)))
    zone = F.explode(F.array_distinct(F.array_compact(F.array(*hits))))
    return entities.select("entity_id", "entity_type", zone.alias("zone"))


def propagate(assigned: DataFrame, edges: DataFrame, value: str, kinds: Sequence[tuple[str, str]]) -> DataFrame:
    """Hands an assigned value on along edges, hop by hop, and gives all (entity, value) pairs.

    kinds: (from type, to type) of every hop in order; edges: from_id, from_type, to_id, to_type.
    """
    done = assigned.select("entity_id", "entity_type", value).distinct()
    for source, target in kinds:
        hop = edges.where((F.col("from_type") == source) & (F.col("to_type") == target))
        reached = (
            done.where(F.col("entity_type") == source)
            .join(hop, F.col("entity_id") == F.col("from_id"))
            .select(F.col("to_id").alias("entity_id"), F.col("to_type").alias("entity_type"), value)
        )
        done = done.unionByName(reached).distinct()
    return done


def inherit(df: DataFrame, key: str, parent: str, column: str, kind: str, allowed: Sequence[str]) -> DataFrame:
    """Fills an empty column from the parent row, for rows of the allowed kinds only."""
    wanted = F.coalesce(F.col(column).isNull() & F.col(kind).isin(list(allowed)) & F.col(parent).isNotNull(), F.lit(False))
    up = df.where(F.col(column).isNotNull()).select(F.col(key).alias("_id"), F.col(column).alias("_inherited"))
    # Only rows that may inherit look for their parent; the others stay out of the join.
    filled = df.where(wanted).join(up, F.col(parent) == F.col("_id"), "left").select(
        *[F.col("_inherited").alias(column) if c == column else c for c in df.columns]
    )
    return df.where(~wanted).unionByName(filled)


def tagged_members(tags: DataFrame, rules: DataFrame) -> DataFrame:
    """Entities that satisfy every tag rule of a service.

    tags: entity_id, category, value; rules: service, category, value.
    """
    needed = rules.distinct().groupBy("service").agg(F.count(F.lit(1)).alias("_rules"))
    hits = (
        tags.distinct()
        .join(rules.distinct(), ["category", "value"])
        .groupBy("service", "entity_id")
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    return hits.join(needed, "service").where("_hits = _rules").select("service", "entity_id")
