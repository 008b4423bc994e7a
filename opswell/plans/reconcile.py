"""Inventory reconciliation: alignments, mappings, specification checks, findings, zones, tags, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from opswell import session
from opswell.functions import text as X
from opswell.operators import reconcile as R, tables, trees
from opswell.plans.ctes import cte, sql
from opswell.plans.joins import host_diff
from opswell.registry import query

# Tags and zones that the totals of §2.4 count

TAG_KEYS = {"R": R.CANONICAL_TAG, "A": R.ALTERNATE_TAGS[0]}


def bindings(t):
    """Line items as tag bindings: the return flag stands for the key, the supplier for the value."""
    flag = F.col("l_returnflag")
    key = F.when(flag == "R", F.lit(TAG_KEYS["R"])).when(flag == "A", F.lit(TAG_KEYS["A"])).otherwise(F.lit("owner"))
    value = F.when(flag == "R", F.concat(F.lit("Svc-"), F.col("l_suppkey"))).otherwise(F.concat(F.lit("svc-id-"), F.col("l_suppkey")))
    return t.lineitem.select(key.alias("key"), value.alias("value"))


cte("tag_counts", """
SELECT CASE WHEN l_returnflag = 'R' THEN 'Svc-' || l_suppkey ELSE 'svc-id-' || l_suppkey END AS value,
  count(*) FILTER (l_returnflag = 'R') AS canonical, count(*) FILTER (l_returnflag = 'A') AS alternate FROM lineitem GROUP BY 1""")


@query("agg44", sql("tag_counts", "SELECT value, canonical, alternate FROM tag_counts"))
def tag_counts(t):
    return R.tag_counts(bindings(t), "key", "value")


def zoned(t):
    """Customers as hosts and suppliers as process groups, with the zones they are in."""
    hosts = t.customer.select(
        F.concat(F.lit("HOST-"), F.col("c_custkey")).alias("entity_id"), F.lit("HOST").alias("entity_type"),
        F.concat(F.lit("host-"), F.col("c_custkey")).alias("display_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("ops"), F.lit("all"))).otherwise(F.array(F.lit("all"))).alias("zones"),
    )
    groups = t.supplier.select(
        F.concat(F.lit("PG-"), F.col("s_suppkey")).alias("entity_id"), F.lit("PROCESS_GROUP").alias("entity_type"),
        F.concat(F.lit("pg-"), F.col("s_suppkey")).alias("display_name"), F.array(F.lit("all")).alias("zones"),
    )
    return hosts.unionByName(groups)


@query("agg45", """
SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS hosts_in_zone, 0::BIGINT AS groups_in_zone, (SELECT count(*) FROM supplier) AS groups,
  (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') > 0 AS finding""")
def zone_coverage(t):
    return R.zone_coverage(zoned(t), "ops")


# Alignments

@query("rec01", sql("host_diff", """
SELECT host, status, location, CASE WHEN l.n IS NOT NULL THEN true ELSE false END AS linked FROM host_diff LEFT JOIN (SELECT o_orderkey AS k, 1 AS n FROM orders WHERE o_orderstatus = 'F') l ON o_orderkey = l.k"""))
def host_alignment(t):
    """Host difference with the identity link of the second side's entity."""
    linked = t.orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("feed|||HOST-"), F.hex("o_orderkey")).alias("id"))
    linked = linked.select(X.last_part("id").alias("_entity")).distinct()
    rows = host_diff(t).join(linked, F.col("right_entity_id") == F.col("_entity"), "left")
    return rows.select("host", "status", F.col("left_location").alias("location"), F.col("_entity").isNotNull().alias("linked"))


cte("cluster_diff", """
SELECT coalesce(l.name, r.name) AS name, l.customers, r.suppliers, CASE WHEN r.name IS NULL THEN 'left_only' WHEN l.name IS NULL THEN 'right_only' ELSE 'matched' END AS status
FROM (SELECT CASE WHEN c_nationkey < 15 THEN n_name ELSE 'cluster-' || c_nationkey END AS name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) l
FULL JOIN (SELECT n_name AS name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) r ON l.name = r.name""")


def cluster_diff(t):
    left = t.customer.groupBy(F.concat(F.lit("cluster-"), F.col("c_nationkey")).alias("name")).agg(F.count(F.lit(1)).alias("customers"))
    right = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("suppliers"))
    names = t.nation.where("n_nationkey < 15").select(F.concat(F.lit("cluster-"), F.col("n_nationkey")).alias("own"), F.col("n_name").alias("theirs"))
    return R.diff(R.through_map(left, "name", names, "own", "theirs"), right, "name", ["customers"], ["suppliers"])


@query("rec02", sql("cluster_diff", "SELECT name, customers, suppliers, status FROM cluster_diff"))
def cluster_alignment(t):
    return cluster_diff(t).select("name", F.col("left_customers").alias("customers"), F.col("right_suppliers").alias("suppliers"), "status")


@query("rec03", """
SELECT coalesce(l.node, r.node) AS node, CASE WHEN r.node IS NULL THEN 'left_only' WHEN l.node IS NULL THEN 'right_only' ELSE 'matched' END AS status
FROM (SELECT DISTINCT 'node-' || s_suppkey AS node FROM supplier) l FULL JOIN (SELECT DISTINCT 'node-' || l_suppkey * 2 AS node FROM lineitem) r ON l.node = r.node""")
def node_alignment(t):
    """Nodes by name, by host name where the name is missing."""
    name = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Node-"), F.col("s_suppkey"), F.lit(".cluster.local")))
    left = t.supplier.select(name.alias("name"), F.concat(F.lit("node-"), F.col("s_suppkey")).alias("host_name"), "s_suppkey")
    left = left.withColumn("node", X.host_label(F.coalesce("name", "host_name")))
    right = t.lineitem.select(X.host_label(F.concat(F.lit("NODE-"), F.col("l_suppkey") * 2)).alias("node"), "l_suppkey").distinct()
    return R.diff(left, right, "node", ["s_suppkey"], ["l_suppkey"]).select("node", "status")


# Imported classes: class of entity, class of record, prefixes its link ids may have. Fixed values.
IMPORTED = [
    ("PROCESS_GROUP", "cmdb_ci_appl", ["PROCESS_GROUP", "PROCESS_GROUP_INSTANCE"]),
    ("SERVICE", "cmdb_ci_service_auto", ["SERVICE"]),
    ("APPLICATION", "cmdb_ci_appl", ["APPLICATION"]),
]

cte("imported", """
SELECT coalesce(e.cls, k.cls) AS entity_type, coalesce(e.entity, k.entity) AS entity, CASE WHEN k.entity IS NULL THEN 'missing' WHEN e.entity IS NULL THEN 'stale' ELSE 'active' END AS state FROM (
  SELECT 'PROCESS_GROUP' AS cls, 'PROCESS_GROUP-' || p_partkey AS entity FROM part WHERE p_size <= 40 UNION ALL SELECT 'SERVICE', 'SERVICE-' || s_suppkey FROM supplier
  UNION ALL SELECT 'APPLICATION', 'APPLICATION-' || c_custkey FROM customer WHERE c_acctbal > 0) e
FULL JOIN (SELECT DISTINCT 'PROCESS_GROUP' AS cls, 'PROCESS_GROUP-' || l_partkey AS entity FROM lineitem WHERE l_quantity < 10
  UNION ALL SELECT DISTINCT 'SERVICE', 'SERVICE-' || l_suppkey * 2 FROM lineitem UNION ALL SELECT DISTINCT 'APPLICATION', 'APPLICATION-' || o_custkey FROM orders WHERE o_orderstatus = 'P') k ON e.entity = k.entity""")


def imported(t):
    entity = lambda prefix, c: F.concat(F.lit(f"{prefix}-"), F.col(c))
    entities = [
        t.part.where("p_size <= 40").select(F.lit("PROCESS_GROUP").alias("entity_type"), entity("PROCESS_GROUP", "p_partkey").alias("entity_id")),
        t.supplier.select(F.lit("SERVICE").alias("entity_type"), entity("SERVICE", "s_suppkey").alias("entity_id")),
        t.customer.where("c_acctbal > 0").select(F.lit("APPLICATION").alias("entity_type"), entity("APPLICATION", "c_custkey").alias("entity_id")),
    ]
    linked = [
        t.lineitem.where("l_quantity < 10").select(entity("feed|||PROCESS_GROUP", "l_partkey").alias("id")),
        t.lineitem.select(F.concat(F.lit("feed|||SERVICE-"), F.col("l_suppkey") * 2).alias("id")),
        t.orders.where("o_orderstatus = 'P'").select(entity("feed|||APPLICATION", "o_custkey").alias("id")),
    ]
    every = R.status_table(linked).select(X.last_part("id").alias("entity")).distinct()
    states = []
    for kind, _, prefixes in IMPORTED:
        mine = every.where(F.col("entity").rlike("^(" + "|".join(prefixes) + ")-"))
        of_kind = R.status_table(entities).where(F.col("entity_type") == kind)
        states.append(R.mapping_state(of_kind, "entity_id", mine, "entity").withColumn("entity_type", F.lit(kind)))
    return R.status_table(states)


@query("rec04", sql("imported", "SELECT entity_type, entity, state FROM imported"))
def imported_mapping(t):
    return imported(t).select("entity_type", "entity", "state")


cte("service_state", """
SELECT s_suppkey, 'Svc ' || s_suppkey AS name, platform, mapping, coalesce(c.canonical, 0) AS canonical, coalesce(a.alternate, 0) AS alternate,
  CASE WHEN s_acctbal < 0 THEN 'missing_in_cmdb' WHEN mapping = 'tags' AND coalesce(c.canonical, 0) > 0 THEN 'ok_canonical_tag' WHEN mapping = 'tags' AND coalesce(a.alternate, 0) > 0 THEN 'ok_alternate_tag_only'
    WHEN mapping = 'tags' THEN 'missing_tag_binding' ELSE 'present_in_cmdb' END AS status
FROM (SELECT *, CASE WHEN s_nationkey < 12 THEN 'kubernetes' ELSE 'host' END AS platform, CASE WHEN s_nationkey < 20 THEN 'tags' ELSE 'manual' END AS mapping FROM supplier)
LEFT JOIN tag_counts c ON c.value = CASE WHEN platform = 'kubernetes' THEN 'Svc-' || s_suppkey ELSE 'Svc ' || s_suppkey END LEFT JOIN tag_counts a ON a.value = 'svc-id-' || s_suppkey""", "tag_counts")


def specification(t):
    return t.supplier.select(
        F.concat(F.lit("Svc "), F.col("s_suppkey")).alias("name"),
        F.concat(F.lit("svc-id-"), F.col("s_suppkey")).alias("identifier"),
        F.when(F.col("s_nationkey") < 12, F.lit("kubernetes")).otherwise(F.lit("host")).alias("platform"),
        F.when(F.col("s_nationkey") < 20, F.lit("tags")).otherwise(F.lit("manual")).alias("service_mapping"),
    )


def service_states(t):
    present = t.supplier.where("s_acctbal >= 0").select(F.concat(F.lit("Svc "), F.col("s_suppkey")).alias("name"))
    return R.service_status(specification(t), present, R.tag_counts(bindings(t), "key", "value"))


@query("rec05", sql("service_state", "SELECT name, platform, canonical AS canonical_tag_count, alternate AS alternate_tag_count, status FROM service_state"))
def service_status(t):
    return service_states(t).select("name", "platform", "canonical_tag_count", "alternate_tag_count", "status")


@query("rec06", """
SELECT name, sample_no, of_total FROM (SELECT name, row_number() OVER (ORDER BY name) AS sample_no, count(*) OVER () AS of_total FROM (
  SELECT DISTINCT 'Svc ' || l_partkey AS name FROM lineitem WHERE 'Svc ' || l_partkey NOT IN (SELECT 'Svc ' || s_suppkey FROM supplier)))""")
def unspecified(t):
    """Inventory rows that the specification does not name, numbered, beside how many there are."""
    found = t.lineitem.select(F.concat(F.lit("Svc "), F.col("l_partkey")).alias("name")).distinct()
    extra = session.settle(found.join(specification(t).select("name"), "name", "left_anti"))
    return tables.top_sample(extra, [], ["name"], 25).select("name", "sample_no", "of_total")


@query("rec07", """
SELECT name, entity_id, issue FROM (
  SELECT 'host-' || o_custkey AS name, CASE WHEN c_custkey IS NOT NULL THEN 'HOST-' || c_custkey END AS entity_id, CASE WHEN c_custkey IS NULL THEN 'missing_entity' WHEN c_mktsegment <> 'BUILDING' THEN 'missing_management_zone' END AS issue
  FROM (SELECT DISTINCT o_custkey * 2 AS o_custkey FROM orders WHERE o_totalprice > 400000) LEFT JOIN customer ON o_custkey = c_custkey) WHERE issue IS NOT NULL""")
def partitions(t):
    """Expected hosts that are missing or not in the expected zone."""
    expected = t.orders.where("o_totalprice > 400000").select(F.concat(F.lit("host-"), F.col("o_custkey") * 2).alias("name")).distinct()
    hosts = zoned(t).where("entity_type = 'HOST'")
    return R.expected_entities(expected, "name", hosts, "display_name", "zones", "ops")


@query("rec08", sql("host_diff", """
SELECT host, location, zone FROM host_diff WHERE status = 'matched' AND location IS NOT NULL AND lower(location) <> lower('SITE ' || length(zone))"""))
def location_mismatch(t):
    """Matched hosts whose locations differ, case aside."""
    rows = host_diff(t).where("status = 'matched' AND left_location IS NOT NULL")
    theirs = F.concat(F.lit("SITE "), F.length("right_zone"))
    return rows.where(F.lower("left_location") != F.lower(theirs)).select(
        "host", F.col("left_location").alias("location"), F.col("right_zone").alias("zone")
    )


cte("findings", """
SELECT 'A_dual_discoverable' AS category, CASE status WHEN 'left_only' THEN 'A1_in_cmdb_not_smartscape' WHEN 'right_only' THEN 'A2_in_smartscape_not_cmdb' ELSE 'A3_ire_mapped' END AS subcategory,
  'host_' || status AS subclass, CASE status WHEN 'matched' THEN 'informational' ELSE 'warning' END AS severity, host AS item FROM host_diff
UNION ALL SELECT 'B_dynatrace_injected', CASE state WHEN 'missing' THEN 'B1_in_smartscape_not_cmdb' WHEN 'stale' THEN 'B2_in_cmdb_not_smartscape' ELSE 'B3_sgc_mapped' END, lower(entity_type) || '_' || state,
  CASE state WHEN 'active' THEN 'informational' ELSE 'warning' END, entity FROM imported
UNION ALL SELECT 'C_specification_alignment', 'csdm', 'service_' || status, 'action_required', name FROM service_state WHERE status IN ('missing_in_cmdb', 'missing_tag_binding', 'ok_alternate_tag_only')""", "host_diff", "imported", "service_state")

# Names under which findings are reported. Fixed values.
HOST_FINDINGS = {"left_only": "A1_in_cmdb_not_smartscape", "right_only": "A2_in_smartscape_not_cmdb", "matched": "A3_ire_mapped"}
IMPORT_FINDINGS = {"missing": "B1_in_smartscape_not_cmdb", "stale": "B2_in_cmdb_not_smartscape", "active": "B3_sgc_mapped"}
SERVICE_FINDINGS = ["missing_in_cmdb", "missing_tag_binding", "ok_alternate_tag_only"]


def findings(t):
    """All findings in one long table: category, subcategory, subclass, severity, item."""
    choose = lambda c, names: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in names.items()])
    level = lambda c, fine: F.when(F.col(c) == fine, F.lit("informational")).otherwise(F.lit("warning"))
    hosts = host_diff(t).select(
        F.lit("A_dual_discoverable").alias("category"), choose("status", HOST_FINDINGS).alias("subcategory"),
        F.concat(F.lit("host_"), "status").alias("subclass"), level("status", "matched").alias("severity"), F.col("host").alias("item"),
    )
    entities = imported(t).select(
        F.lit("B_dynatrace_injected").alias("category"), choose("state", IMPORT_FINDINGS).alias("subcategory"),
        F.concat(F.lower("entity_type"), F.lit("_"), "state").alias("subclass"), level("state", "active").alias("severity"), F.col("entity").alias("item"),
    )
    services = service_states(t).where(F.col("status").isin(SERVICE_FINDINGS)).select(
        F.lit("C_specification_alignment").alias("category"), F.lit("csdm").alias("subcategory"),
        F.concat(F.lit("service_"), "status").alias("subclass"), F.lit("action_required").alias("severity"), F.col("name").alias("item"),
    )
    return R.status_table([hosts, entities, services])


@query("rec09", sql("findings", """
SELECT category, subcategory, subclass, severity, item, sample_no, of_total, sample_no <= 50 AS shown FROM (
  SELECT *, row_number() OVER (PARTITION BY category, subcategory, subclass, severity ORDER BY item) AS sample_no, count(*) OVER (PARTITION BY category, subcategory, subclass, severity) AS of_total FROM findings)"""))
def findings_tree(t):
    """Every finding's items with their places; the first 50 of each are shown."""
    return R.findings_tree(session.settle(findings(t)), "item", 50).select("category", "subcategory", "subclass", "severity", "item", "sample_no", "of_total", "shown")


@query("agg46", sql("findings", "SELECT severity, count(*) AS items, count(DISTINCT subclass) AS findings FROM findings GROUP BY 1"))
def findings_by_severity(t):
    per = findings(t).groupBy("severity", "subclass").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("severity").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("findings"))


@query("agg46_summary", sql("findings", """
SELECT count(*) FILTER (subclass = 'host_matched') AS hosts_matched, count(*) FILTER (subclass = 'host_left_only') AS hosts_left_only, count(*) FILTER (subclass = 'host_right_only') AS hosts_right_only,
  count(*) FILTER (severity = 'action_required') AS action_required, count(*) AS items FROM findings"""))
def report_summary(t):
    of = lambda c, v: F.count_if(F.col(c) == v)
    return findings(t).agg(
        of("subclass", "host_matched").alias("hosts_matched"), of("subclass", "host_left_only").alias("hosts_left_only"),
        of("subclass", "host_right_only").alias("hosts_right_only"), of("severity", "action_required").alias("action_required"),
        F.count(F.lit(1)).alias("items"),
    )


@query("rec10", """
SELECT 'Agent on c' || c_custkey AS name, 'agent-c' || c_custkey AS identifier, r_name AS "group" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""")
def expanded_services(t):
    """Service templates, one service per member of the template's host group."""
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    groups = nations.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    direct = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.concat(F.lit("C"), F.col("c_custkey")).alias("member"))
    members = trees.members(groups, direct, "parent", "child", "n_name", "member")
    templates = t.region.where("r_name IN ('ASIA', 'EUROPE')").select(
        F.col("r_name").alias("group"), F.lit("Agent on {host_lower}").alias("name"), F.lit("agent-{host_lower}").alias("identifier")
    )
    rows = templates.join(members, "group")
    return rows.select(X.expand("name", "member").alias("name"), X.expand("identifier", "member").alias("identifier"), "group")


@query("rec11", """
SELECT 'svc-' || s_suppkey AS source, 'svc-' || unnest([s_suppkey + 1, s_suppkey + 2]) AS target, unnest(['depends_on', 'runs_on']) AS type FROM supplier""")
def dependency_edges(t):
    """A specification whose dependencies are a name or an object, flattened to edges."""
    svc = lambda n: F.concat(F.lit("svc-"), F.col("s_suppkey") + n)
    spec = t.supplier.select(
        F.to_json(
            F.struct(
                svc(0).alias("name"),
                F.array(
                    F.to_json(F.struct(svc(1).alias("name"), F.lit("depends_on").alias("type"))),
                    F.concat(F.lit("runs_on:"), svc(2)),
                ).alias("depends_on"),
            )
        ).alias("document")
    )
    rows = spec.select(F.from_json("document", "name STRING, depends_on ARRAY<STRING>").alias("d")).select(
        F.col("d.name").alias("source"), F.explode("d.depends_on").alias("edge")
    )
    is_object = F.col("edge").startswith("{")
    return rows.select(
        "source",
        F.when(is_object, F.get_json_object("edge", "$.name")).otherwise(F.substring_index("edge", ":", -1)).alias("target"),
        F.when(is_object, F.get_json_object("edge", "$.type")).otherwise(F.substring_index("edge", ":", 1)).alias("type"),
    )


@query("rec12", """
SELECT coalesce(d.parent, o.parent) AS parent, coalesce(d.child, o.child) AS child, 'runs' AS relationship, CASE WHEN o.parent IS NULL THEN 'missing' WHEN d.parent IS NULL THEN 'undeclared' ELSE 'confirmed' END AS audit
FROM (SELECT DISTINCT l_suppkey AS parent, l_partkey AS child FROM lineitem WHERE l_linestatus = 'O') d FULL JOIN (SELECT DISTINCT l_suppkey AS parent, l_partkey AS child FROM lineitem WHERE l_linestatus = 'F') o ON d.parent = o.parent AND d.child = o.child""")
def audited_relations(t):
    rows = lambda status: t.lineitem.where(F.col("l_linestatus") == status).select(
        F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("child"), F.lit("runs").alias("relationship")
    )
    return R.audit_relations(rows("O"), rows("F"), ["parent", "child", "relationship"])


ZONE_RULES = [
    ("HOST", "group", "equals", "BUILDING", "ops"),
    ("HOST", "group", "equals", "machinery", "plant"),
    ("CLOUD_APPLICATION", "name", "begins", "spark-", "ops"),
    ("KUBERNETES_CLUSTER", "name", "equals", "main", "ops"),
]

cte("zone_pairs", """
SELECT 'HOST-' || c_custkey AS entity_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'ops' ELSE 'plant' END AS zone FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
UNION SELECT 'CLOUD_APPLICATION-' || s_suppkey, 'ops' FROM supplier WHERE s_acctbal > 0
UNION SELECT 'PG-' || o_orderkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'ops' ELSE 'plant' END FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")


def topology(t):
    """Customers as hosts and suppliers as workloads; orders as process groups on hosts; lines as services of those."""
    hosts = t.customer.select(
        F.concat(F.lit("HOST-"), F.col("c_custkey")).alias("entity_id"), F.lit("HOST").alias("entity_type"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("group"),
    )
    workloads = t.supplier.select(
        F.concat(F.lit("CLOUD_APPLICATION-"), F.col("s_suppkey")).alias("entity_id"), F.lit("CLOUD_APPLICATION").alias("entity_type"),
        F.concat(F.when(F.col("s_acctbal") > 0, F.lit("Spark-")).otherwise(F.lit("Other-")), "s_suppkey").alias("name"), F.lit("").alias("group"),
    )
    on_host = t.orders.select(
        F.concat(F.lit("HOST-"), F.col("o_custkey")).alias("from_id"), F.lit("HOST").alias("from_type"),
        F.concat(F.lit("PG-"), F.col("o_orderkey")).alias("to_id"), F.lit("PROCESS_GROUP").alias("to_type"),
    )
    of_group = t.lineitem.select(
        F.concat(F.lit("PG-"), F.col("l_orderkey")).alias("from_id"), F.lit("PROCESS_GROUP").alias("from_type"),
        F.concat(F.lit("SERVICE-"), F.col("l_partkey")).alias("to_id"), F.lit("SERVICE").alias("to_type"),
    )
    return hosts.unionByName(workloads), on_host.unionByName(of_group)


@query("rec13", sql("zone_pairs", "SELECT entity_id, zone FROM zone_pairs"))
def zones(t):
    """Zones by rules, handed on from hosts to their process groups."""
    entities, edges = topology(t)
    assigned = R.zones_by_rule(entities, ZONE_RULES)
    return R.propagate(assigned, edges, "zone", [("HOST", "PROCESS_GROUP")]).select("entity_id", "zone")


@query("rec14", """
SELECT entity_id, 'Project:main' AS tag FROM (
  SELECT 'HOST-' || c_custkey AS entity_id FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'PG-' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
  UNION SELECT 'SERVICE-' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')""")
def tags(t):
    """Tags by rule, handed on from hosts to process groups and from those to services."""
    entities, edges = topology(t)
    rule = [("HOST", "group", "equals", "BUILDING", "Project:main")]
    assigned = R.zones_by_rule(entities, rule).withColumnRenamed("zone", "tag")
    hops = [("HOST", "PROCESS_GROUP"), ("PROCESS_GROUP", "SERVICE")]
    return R.propagate(assigned, edges, "tag", hops).select("entity_id", "tag")


# Classes of records that may take their location from the host. Fixed values.
INFRASTRUCTURE = [
    "cmdb_ci_linux_server", "cmdb_ci_win_server", "cmdb_ci_computer", "cmdb_ci_vm_instance", "cmdb_ci_vmware_instance",
    "cmdb_ci_kubernetes_node", "cmdb_ci_kubernetes_cluster", "cmdb_ci_docker_container", "cmdb_ci_cloud_host",
]


@query("rec15", """
SELECT 'o' || o_orderkey AS sys_id, CASE WHEN o_orderstatus = 'F' THEN 'own' WHEN o_orderstatus = 'O' THEN CASE WHEN c_acctbal > 0 THEN 'site ' || c_nationkey END END AS location FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_acctbal > 0 THEN 'site ' || c_nationkey END FROM customer""")
def inherited_locations(t):
    hosts = t.customer.select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("sys_id"), F.lit(None).cast("string").alias("host"), F.lit("cmdb_ci_computer").alias("class"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("site "), F.col("c_nationkey"))).alias("location"),
    )
    status = F.col("o_orderstatus")
    records = t.orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("sys_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("host"),
        F.when(status == "P", F.lit("cmdb_ci_appl")).otherwise(F.lit("cmdb_ci_linux_server")).alias("class"),
        F.when(status == "F", F.lit("own")).alias("location"),
    )
    return R.inherit(hosts.unionByName(records), "sys_id", "host", "location", "class", INFRASTRUCTURE).select("sys_id", "location")


@query("rec16", """
SELECT 'R-A' AS service, count(*) AS members FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_linestatus = 'O') > 0)
UNION ALL SELECT 'N', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)""")
def tag_members(t):
    """Services by their tag rules; a part belongs to a service when it satisfies all of them."""
    tags_ = t.lineitem.select(F.col("l_partkey").alias("entity_id"), F.lit("flag").alias("category"), F.col("l_returnflag").alias("value")).unionByName(
        t.lineitem.select(F.col("l_partkey").alias("entity_id"), F.lit("status").alias("category"), F.col("l_linestatus").alias("value"))
    )
    rules = t.spark.createDataFrame(
        [("R-A", "flag", "R"), ("R-A", "status", "O"), ("N", "flag", "N")], "service string, category string, value string"
    )
    return R.tagged_members(tags_, rules).groupBy("service").agg(F.count(F.lit(1)).alias("members"))
