"""Column expressions over text. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **costly: Column) -> DataFrame:
    """Adds columns that are computed a single time per row.

    A filter on a computed column is moved below the projection that computes it
    and computes it again there. It does not move below an explode, so the
    column is made as the one element of an exploded array.
    """
    for name, c in costly.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(col(c), F.lit(""))


def filled(*cs: Column | str) -> Column:
    """True where every text is there and not blank."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.trim(col(c)), F.lit("")) != "" for c in cs])


def first_word(c: Column | str) -> Column:
    """First run of plain letters, lower-cased; empty when there is none."""
    return F.regexp_extract(F.lower(col(c)), "[a-z]+", 0)


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group, null (not empty) when the pattern does not match."""
    return present(F.regexp_extract(col(c), pattern, group))


def first_match(c: Column | str, patterns: Sequence[str], group: int = 1) -> Column:
    """Group of the first pattern in the list that matches."""
    return F.coalesce(*[extract(c, p, group) for p in patterns])


# Escapes in the order they must be applied: the ampersand comes first. Fixed values.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def html_escape(c: Column | str) -> Column:
    return reduce(lambda e, pair: F.replace(e, F.lit(pair[0]), F.lit(pair[1])), HTML_ESCAPES, col(c))


def label(c: Column | str) -> Column:
    """A name in the characters a label may hold: other runs become a dash, edge punctuation goes."""
    return F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")


def host_label(c: Column | str) -> Column:
    return F.lower(F.split(col(c), "\\.")[0])


def text_of(c: Column | str) -> Column:
    """Text of a field that holds either a plain value or an object with display_value and value."""
    c = col(c)
    as_object = F.coalesce(
        present(F.get_json_object(c, "$.display_value")), present(F.get_json_object(c, "$.value")), F.lit("")
    )
    return F.when(c.startswith("{"), as_object).otherwise(F.coalesce(c, F.lit("")))


def base_name(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "([^/]+)$", 1)


def last_part(c: Column | str, separator: str = "|||") -> Column:
    """What stands after the last separator, trimmed; the whole text when there is none."""
    return F.trim(F.substring_index(col(c), separator, -1))


def clock_seconds(c: Column | str) -> Column:
    """Seconds of HH:MM:SS at fixed offsets; null when a part is not a number."""
    c = col(c)
    part = lambda at: F.substring(c, at, 2).try_cast("int")
    return part(1) * 3600 + part(4) * 60 + part(7)


def clock_seconds_anywhere(c: Column | str) -> Column:
    """Seconds of the trailing HH:MM:SS[.fraction], 0 when the text does not end in one."""
    c = col(c)
    pattern = "(\\d{2}):(\\d{2}):(\\d{2})(?:\\.\\d+)?$"
    part = lambda g: F.regexp_extract(c, pattern, g).try_cast("int")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0))


# Entity types by id prefix. Where one prefix starts another, the longer one is
# tried first. Fixed values.
ENTITY_TYPES = ["HOST", "CUSTOM_DEVICE", "CLOUD_APPLICATION_INSTANCE", "CLOUD_APPLICATION"]


def entity_type(kind: Column | str, entity_id: Column | str) -> Column:
    kind, entity_id = col(kind), col(entity_id)
    out = F.lit(None).cast("string")
    for name in reversed(ENTITY_TYPES):
        hit = F.coalesce(kind == name, F.lit(False)) | F.coalesce(entity_id.startswith(f"{name}-"), F.lit(False))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, present(kind), F.lit("UNKNOWN"))


def expand(template: Column | str, host: Column | str) -> Column:
    """Fills {host} and {host_lower}."""
    host = col(host)
    return F.replace(F.replace(col(template), F.lit("{host_lower}"), F.lower(host)), F.lit("{host}"), host)


def record_link(base: Column | str, table: Column | str, key: Column | str) -> Column:
    """Deep link to one record; empty when a part is missing."""
    base, table, key = col(base), col(table), col(key)
    target = F.url_encode(F.concat(table, F.lit(".do?sys_id="), key))
    link = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/nav_to.do?uri="), target)
    return F.when(filled(base, table, key), link).otherwise(F.lit(""))


# Kinds of entities as their ids begin. Fixed values.
ENTITY_KINDS = [
    "HOST", "PROCESS_GROUP", "PROCESS_GROUP_INSTANCE", "CONTAINER_GROUP_INSTANCE", "SERVICE", "APPLICATION",
    "POD", "NODE", "CLUSTER", "KUBERNETES_CLUSTER", "KUBERNETES_NODE",
]


def entity_part(c: Column | str, separator: str = "|||") -> Column:
    """The last part that has the form of an entity's id, a kind and a hexadecimal number; the last part when none has."""
    parts = F.transform(F.split(col(c), r"\Q" + separator + r"\E"), lambda x: F.trim(x))
    entities = F.filter(parts, lambda x: x.rlike(f"(?i)^(?:{'|'.join(ENTITY_KINDS)})-[A-F0-9]+$"))
    return F.coalesce(F.try_element_at(entities, F.lit(-1)), F.trim(F.substring_index(col(c), separator, -1)))


def ui_base(url: Column | str, domain: str) -> Column:
    """Base address of the user interface behind an address of the programming interface.

    domain: what follows `.apps` in hosts that have a twin under `.live`; any other address stays as it is.
    """
    c = F.regexp_replace(col(url), "/+$", "")
    c = F.regexp_replace(c, "(?i)/api/?$", "")
    return F.regexp_replace(c, r"(?i)\.apps\Q" + domain + r"\E$", f".live{domain}")


def entity_link(url: Column | str, entity_id: Column | str, domain: str) -> Column:
    entity = entity_part(entity_id)
    return F.when(filled(url, entity), F.concat(ui_base(url, domain), F.lit("/ui/nav/"), entity)).otherwise(F.lit(""))


def stamp_patterns(keys: Sequence[str], value: str) -> list[str]:
    """Patterns for key=value and "key":"value" in free text, all keys in order of preference."""
    out = []
    for key in keys:
        k = key.replace(".", "\\.")
        out.append(f"(?i)(?:^|[\\s,{{;]){k}\\s*[=:]\\s*({value})")
        out.append(f"(?i)[\"']{k}[\"']\\s*:\\s*[\"']({value})[\"']")
    return out


# Spellings of the stamped fields, preferred first, and the form of their values. Fixed values.
SERVICE_KEYS = ["sn-service_instance", "sn.service_instance", "l2i.service_instance", "service_instance"]
SIGNATURE_KEYS = ["sn-log-signature", "sn.log.signature", "log.signature"]
KIND_KEYS = ["sn-event_kind", "sn.event_kind", "log.event_kind"]
POD_KEYS = ["k8s-pod-name", "k8s.pod.name"]
WORKLOAD_KEYS = ["k8s-workload-name", "k8s.workload.name"]
WORKLOAD_KIND_KEYS = ["k8s-workload-kind", "k8s.workload.kind"]
CRON_KEYS = ["k8s-cronjob-name", "k8s.cronjob.name"]
JOB_KEYS = ["k8s-job-name", "k8s.job.name"]
NAME_VALUE = "[A-Za-z0-9][\\w.-]*"
SIGNATURE_VALUE = "[A-Za-z_][\\w$]*:\\d+"
KIND_VALUE = "[A-Za-z0-9_]+"
CHOICE_VALUE = "[1-3]"


def service_stamp(c: Column | str) -> Column:
    return first_match(c, stamp_patterns(SERVICE_KEYS, NAME_VALUE))


def signature_stamp(c: Column | str) -> Column:
    return first_match(c, stamp_patterns(SIGNATURE_KEYS, SIGNATURE_VALUE))


def kind_stamp(c: Column | str) -> Column:
    return first_match(c, stamp_patterns(KIND_KEYS, KIND_VALUE))


def choice_stamp(c: Column | str, key: str) -> Column:
    return first_match(c, stamp_patterns([key], CHOICE_VALUE)).try_cast("int")


def property_of(properties: Column, c: Column | str, keys: Sequence[str]) -> Column:
    """A property by any of its keys: from the map first, then from the text."""
    return F.coalesce(
        *[present(F.try_element_at(properties, F.lit(k))) for k in keys],
        first_match(c, stamp_patterns(keys, NAME_VALUE)),
    )


def groups(c: Column | str, pattern: str, n: int) -> Column:
    """All n groups of a pattern found anywhere in the text as an array, null when it is not found.

    One match per row: the text is replaced by its groups with a separator between them.
    """
    mark = "\u0001"
    replaced = F.regexp_replace(col(c), f"(?s)^.*?{pattern}.*$", mark.join(f"${i + 1}" for i in range(n)))
    parts = F.split(replaced, mark)
    return F.when(F.size(parts) == n, parts)
