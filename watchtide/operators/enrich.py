"""Enrich: identity, technique tags, criticality, threat-intel matches, entities.

Reference lists join on equality and carry one row per key, so an enriched event table has exactly
the rows of its input.  No broadcast hint is given: Spark broadcasts a list when its size is below
``spark.sql.autoBroadcastJoinThreshold`` (measured at run time under AQE) and otherwise shuffles,
where AQE splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide import fixed
from watchtide.functions.core import (
    any_of, chosen, contains_any, entity_id, fence, literal_map, lookup, sorted_union)
from watchtide.operators.running import as_of

INTEL_FIELDS = ["src_ip", "dst_ip", "domain", "url", "file_hash"]


def _join_key(value: Column, row_id: str = "event_id") -> Column:
    """Join key that spreads rows without a value over many keys that match nothing.

    Most events lack most fields; as plain nulls they would all meet in one task of a shuffled join.
    """
    nothing = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(row_id), F.lit(1009)).cast("string"))
    return F.coalesce(value, nothing)


def resolve_user(user: Column) -> Column:
    name = F.lower(F.trim(F.element_at(F.split(user, r"\\"), -1)))
    return F.when(F.length(user) > 0, F.coalesce(lookup(fixed.USER_ALIASES, name), name))


def resolve_host(host: Column) -> Column:
    return F.when(F.length(host) > 0, F.upper(F.trim(host)))


def infer_techniques(text: Column, extra_keywords: dict[str, list[str]] | None = None) -> Column:
    """Sorted technique ids whose keywords occur in already lower-cased text."""
    rules = {t: list(words) for t, words in fixed.KEYWORD_TECHNIQUES.items()}
    for technique, words in (extra_keywords or {}).items():
        rules.setdefault(technique, []).extend(words)
    return chosen(*[(contains_any(text, words), F.lit(t)) for t, words in sorted(rules.items())])


def technique_text() -> Column:
    return F.lower(F.concat_ws(" ", "event_type", "command_line", "file_path", "email_subject", "url"))


def latest_indicators(feed: DataFrame, order: str = "load_order") -> DataFrame:
    """One row per lower-cased indicator value; the last one loaded wins."""
    return feed.where("value IS NOT NULL").groupBy(F.lower("value").alias("ioc_key")).agg(
        F.max_by(F.struct(*[c for c in feed.columns if c != order]), order).alias("ioc"))


def indicator_versions(feed: DataFrame, since: str, order: str = "load_order") -> DataFrame:
    """(ioc_key, since, ioc): one row per lower-cased value and time it was loaded; a null confidence takes a value away."""
    loaded = feed.where("value IS NOT NULL").groupBy(F.lower("value").alias("ioc_key"), F.col(since).alias("since")).agg(
        F.max_by(F.struct("confidence", "indicator_id"), order).alias("ioc"))
    return loaded.withColumn("ioc", F.when(F.col("ioc.confidence").isNotNull(), F.col("ioc")))


def match_indicators_as_of(events: DataFrame, versions: DataFrame, t: str, fields: list[str] = INTEL_FIELDS) -> DataFrame:
    """Like :func:`match_indicators`, with the list as it was at each event's time.

    Only (event_id, field, key, time) of the values travel to the versions; what is found comes back as one row per event.
    """
    asked = events.select("event_id", F.col(t).alias("at"), F.posexplode(F.array(*fields)).alias("place", "matched_value")).where(
        F.col("matched_value").isNotNull()).withColumn("ioc_key", F.lower("matched_value"))
    found = as_of(asked, versions, ["ioc_key"], "at", "since", "ioc").where(F.col("ioc").isNotNull())
    hits = found.groupBy(F.col("event_id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct(
        "place", "matched_value", F.col("ioc.confidence").alias("confidence"), F.col("ioc.indicator_id").alias("indicator_id")))).alias("_hits"))
    out = events.join(hits, F.col("event_id") == F.col("_of"), "left")
    return out.withColumn("intel_hits", F.transform(F.coalesce("_hits", F.array().cast(hits.schema["_hits"].dataType)), lambda h: F.struct(
        h["matched_value"].alias("matched_value"), h["confidence"].alias("confidence"), h["indicator_id"].alias("indicator_id")))).withColumn(
        "intel_matches", F.transform("intel_hits", lambda h: h["matched_value"])).drop("_of", "_hits")


def match_indicators(events: DataFrame, indicators: DataFrame, fields: list[str] = INTEL_FIELDS) -> DataFrame:
    """Add ``intel_hits`` (indicator plus matched value, in field order) and ``intel_matches``.

    One left join per field keeps the event row in place, so nothing has to be exploded and grouped
    back together.
    """
    out = events
    hits = []
    for name in fields:
        side = indicators.select(F.col("ioc_key").alias(f"_k_{name}"), F.col("ioc").alias(f"_i_{name}"))
        out = out.join(side, _join_key(F.lower(name)) == F.col(f"_k_{name}"), "left")
        hit = F.struct(
            F.col(name).alias("matched_value"), F.col(f"_i_{name}.confidence").alias("confidence"),
            F.col(f"_i_{name}.indicator_id").alias("indicator_id"))
        hits.append((F.col(f"_k_{name}").isNotNull(), hit))
    out = out.withColumn("intel_hits", chosen(*hits))
    out = out.drop(*[f"_{x}_{n}" for x in "ki" for n in fields])
    return out.withColumn("intel_matches", F.transform("intel_hits", lambda h: h["matched_value"]))


def add_criticality(events: DataFrame, hosts: DataFrame, users: DataFrame,
                    default_host: float = fixed.DEFAULT_CRITICALITY,
                    default_user: float = fixed.DEFAULT_CRITICALITY) -> DataFrame:
    """Host, user and combined criticality.  ``hosts``/``users`` hold one row per name."""
    def meta(df: DataFrame, prefix: str) -> DataFrame:
        rest = [c for c in df.columns if c != "name"]
        return df.select(F.col("name").alias(f"_{prefix}"), F.struct(*rest).alias(f"{prefix}_meta"))
    out = events.join(meta(hosts, "host"), _join_key(F.col("host")) == F.col("_host"), "left")
    out = out.join(meta(users, "user"), _join_key(F.lower("user")) == F.col("_user"), "left").drop("_host", "_user")
    def rate(prefix: str, default: float) -> Column:
        known = F.coalesce(F.col(f"{prefix}_meta.criticality"), F.lit(fixed.DEFAULT_CRITICALITY))
        return F.when(F.col(f"{prefix}_meta").isNull(), F.lit(default)).otherwise(known)
    out = out.withColumn("host_criticality", rate("host", default_host))
    out = out.withColumn("user_criticality", rate("user", default_user))
    return out.withColumn("asset_criticality", F.round(F.greatest("host_criticality", "user_criticality"), 3))


def _attributes(**cols: Column) -> Column:
    pairs = [(c.isNotNull(), F.struct(F.lit(n).alias("key"), c.cast("string").alias("value"))) for n, c in cols.items()]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(chosen(*pairs))


def extract_entities() -> tuple[Column, Column]:
    """Entity structs of a canonical event: those of its fields, in a fixed kind order, and those of its techniques."""
    c = F.col
    tenant = c("tenant_id")
    none = F.lit("None")

    def text(name: str) -> Column:
        return F.coalesce(c(name).cast("string"), none)

    def entity(kind: str, key: Column, display: Column, present: Column, attrs: Column | None = None) -> tuple[Column, Column]:
        return present, F.struct(
            F.lit(kind).alias("type"), entity_id(kind, key, tenant).alias("id"),
            F.coalesce(display, key).alias("display_name"),
            (attrs if attrs is not None else _attributes()).alias("attributes"))

    def simple(kind: str, name: str, attrs: Column | None = None) -> tuple[Column, Column]:
        return entity(kind, c(name), c(name), F.length(name) > 0, attrs)

    def process(name: str, pid: str) -> tuple[Column, Column]:
        key = F.concat_ws(":", text("host"), c(name), text(pid))
        return entity("Process", key, c(name), F.length(name) > 0, _attributes(process_id=c(pid), host=c("host")))

    fixed_part = chosen(
        simple("Host", "host"), simple("User", "user"),
        process("process", "process_id"), process("parent_process", "parent_process_id"),
        simple("File", "file_path", _attributes(host=c("host"))), simple("Hash", "file_hash"),
        simple("IP", "src_ip"), simple("IP", "dst_ip"), simple("Domain", "domain"), simple("URL", "url"),
        simple("RegistryKey", "registry_key", _attributes(host=c("host"))),
        entity("Email", F.concat(text("email_from"), F.lit("->"), text("email_to"), F.lit(":"), text("email_subject")),
               c("email_subject"), any_of([F.length("email_from") > 0, F.length("email_to") > 0]),
               _attributes(email_from=c("email_from"), email_to=c("email_to"))),
        simple("CloudResource", "cloud_resource", _attributes(cloud_account=c("cloud_account"))),
        entity("K8sWorkload", F.concat(text("k8s_namespace"), F.lit("/"), c("k8s_pod")), c("k8s_pod"), F.length("k8s_pod") > 0),
    )
    techniques = F.transform("technique_ids", lambda t: F.struct(
        F.lit("AttackTechnique").alias("type"), entity_id("AttackTechnique", t, tenant).alias("id"),
        t.alias("display_name"), _attributes().alias("attributes")))
    return fixed_part, techniques


def technique_names(ids: Column) -> Column:
    names = literal_map({t: name for t, (name, _) in fixed.TECHNIQUE_CATALOG.items()})
    return F.transform(ids, lambda t: F.coalesce(F.try_element_at(names, t), t))


def enrich(events: DataFrame, indicators: DataFrame, hosts: DataFrame, users: DataFrame,
           extra_keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """Canonical events with resolved names, technique ids, criticality, intel hits and entities.

    ``indicators`` comes from :func:`latest_indicators`.
    """
    out = events.withColumn("user", resolve_user(F.col("user"))).withColumn("host", resolve_host(F.col("host")))
    # fenced, or the text would be put together anew for every keyword
    out = out.withColumn("_text", fence(technique_text())).withColumn("_found", fence(infer_techniques(F.col("_text"), extra_keywords)))
    out = out.withColumn("technique_ids", sorted_union(F.col("technique_ids"), F.col("_found"))).drop("_text", "_found")
    out = add_criticality(out, hosts, users)
    out = match_indicators(out, indicators)
    # rows are exploded by entity; the filter Spark infers for that would work all of them out once more
    fixed_part, techniques = extract_entities()
    out = out.withColumn("_fixed", fence(fixed_part)).withColumn("entities", fence(F.concat(F.col("_fixed"), techniques))).drop("_fixed")
    enrichment = F.struct(
        "host_criticality", "host_meta", "user_criticality", "user_meta", "intel_hits",
        technique_names(F.col("technique_ids")).alias("technique_names"), F.size("entities").alias("entity_count"))
    return out.withColumn("enrichment", enrichment).drop(
        "host_criticality", "host_meta", "user_criticality", "user_meta")
