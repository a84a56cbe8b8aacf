"""Catalogue records, benchmark scenarios and process definitions as nested DataFrames: lookups, joins and rule checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The conformance class that every record names, and the patterns of ids (fixed values).
CORE = "https://www.opengis.net/spec/ogcapi-records-1/1.0/req/record-core"
SCENARIO_ID = r"^[a-zA-Z0-9_-]+$"
PROCESS_ID = r"^[a-zA-Z0-9_-]+$"
PROCESS_LINK = "application/vnd.openeo+json;type=process"

RECORD = (
    "id string, type string, conformsTo array<string>, properties struct<type string, title string, description string, visibility string, "
    "cost_estimate double, cost_unit string, keywords array<string>, created string, updated string, formats array<struct<name string>>, "
    "contacts array<struct<name string, organization string, roles array<string>, links array<struct<rel string, type string, title string, href string>>>>>, "
    "license string, links array<struct<rel string, type string, title string, href string>>"
)
SCENARIO = (
    "id string, type string, description string, backend string, endpoint string, application string, namespace string, parameters map<string, string>, "
    "process_graph map<string, struct<process_id string, namespace string, arguments string>>, "
    "reference_data map<string, string>, reference_options struct<rtol double, atol double, pixel_tolerance double>"
)
PROCESS = "id string, description string, parameters array<struct<name string, description string, schema string>>, process_graph string"


def links_of(rel: str) -> Column:
    return F.filter("links", lambda x: x["rel"] == rel)


def profiles() -> Column:
    """The conformance classes of a record besides the core."""
    return F.filter("conformsTo", lambda x: x != CORE)


def link_of(rel: str) -> Column:
    return F.get(F.transform(links_of(rel), lambda x: x["href"]), F.lit(0))


def path_part(path: Column | str, from_end: int) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(path_part(path, 1), r"\.json$", "")


def list_algorithms(records: DataFrame, path: str = "path") -> DataFrame:
    """(organisation, algorithm) of records kept as <organisation>/<algorithm>/records/<file>."""
    return records.where(path_part(path, 2) == "records").select(path_part(path, 4).alias("organisation"), path_part(path, 3).alias("algorithm")).distinct()


def get_algorithms(records: DataFrame, names: DataFrame) -> DataFrame:
    """For each name asked for, the record of that algorithm, flattened; `error` says why there is none or it isn't usable.

    A name must be an algorithm of exactly one organisation; its record is <organisation>/<name>/records/<name>.json. It must be a Feature that
    conforms to the core, of type service, with one process link at most (of the right media type, if it has one) and a service link.
    """
    owners = list_algorithms(records).groupBy(F.col("algorithm").alias("name")).agg(F.count("*").alias("_owners"))
    at = records.where((path_part("path", 2) == "records") & (path_part("path", 3) == file_stem("path"))).withColumn("name", file_stem("path"))
    found = names.select("name").distinct().join(owners, "name", "left").join(at, "name", "left")
    udp, services = F.coalesce(links_of("application"), F.array()), F.coalesce(links_of("service"), F.array())
    lead = F.get(F.filter("properties.contacts", lambda p: F.array_contains(p["roles"], "principal investigator")), F.lit(0))
    error = (
        F.when(F.coalesce("_owners", F.lit(0)) != 1, "not an algorithm of exactly one organisation")
        .when(F.col("path").isNull(), "no record")
        .when(~F.equal_null("type", F.lit("Feature")), "not a GeoJSON feature")
        .when(~F.coalesce(F.array_contains("conformsTo", CORE), F.lit(False)), "does not conform to the record core")
        .when(~F.equal_null("properties.type", F.lit("service")), "not a service")
        .when(F.exists(udp, lambda x: x["type"] != PROCESS_LINK), "process link of another media type")
        .when(F.exists(udp, lambda x: x["href"].isNull()) | F.exists(services, lambda x: x["href"].isNull()), "link without href")
        .when(F.size(udp) > 1, "several process links")
        .when(F.size(services) == 0, "no service link")
    )
    return found.select(
        "name", "id", F.col("properties.title").alias("title"), F.col("properties.description").alias("description"), F.get(udp, F.lit(0))["href"].alias("udp_href"),
        F.transform(services, lambda s: s["href"]).alias("service_hrefs"), "license", lead["organization"].alias("organization"), error.alias("error"),
    )


def get_algorithm(records: DataFrame, name: str) -> DataFrame:
    """The one record of an algorithm, flattened; where there is none or it isn't usable, the job fails and says why."""
    found = get_algorithms(records, records.sparkSession.createDataFrame([(name,)], "name string"))
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit(f"{name}: "), "error")).cast("string")).otherwise(F.col("id"))
    return found.withColumn("id", checked).drop("name", "error")


def _violations(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for each rule that a row breaks; a rule that can't be decided is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


#: Links that a service's record must have, and where two of them must point (fixed values).
SERVICE_LINKS = ("service", "application", "provider", "platform")
RECORD_PLACES = {"platform": r"^(\.\./){4}platform_catalog/\S+\.json$", "provider": r"^(\.\./){2}record\.json$"}
NOTEBOOK = "application/x-ipynb+json"


def lint_records(records: DataFrame) -> DataFrame:
    """(id, rule) for each rule that a record breaks.

    Links may be relative; absolute ones are https (or an image's oci). A service has a link of each of SERVICE_LINKS, platform and provider
    at their places; its file is <id>/records/<id>.json. A platform's file has its id, a provider's is record.json.
    """
    kind, links = F.col("properties.type"), F.coalesce("links", F.array())
    service = F.equal_null(kind, F.lit("service"))
    every = lambda test: ~F.exists(links, lambda x: ~F.coalesce(test(x), F.lit(False)))
    rules = {
        "type": F.col("type") == "Feature",
        "conforms to core": F.array_contains("conformsTo", CORE),
        "exactly one profile": F.size(profiles()) == 1,
        "properties.type": kind.isin("service", "platform", "provider"),
        "title": F.length("properties.title") > 0,
        "description": F.length("properties.description") > 0,
        "created": F.col("properties.created").isNotNull(),
        "updated": F.col("properties.updated").isNotNull(),
        "link fields": ~service | every(lambda x: x["rel"].isNotNull() & x["type"].isNotNull() & x["title"].isNotNull() & x["href"].isNotNull()),
        "https": every(lambda x: ~x["href"].rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | x["href"].rlike("^(https|oci)://")),
        "notebook type": every(lambda x: ~F.equal_null(x["rel"], F.lit("notebook")) | (x["type"] == NOTEBOOK)),
    }
    is_ = lambda rel: lambda x: F.equal_null(x["rel"], F.lit(rel))
    at = lambda rel, place: lambda x: ~is_(rel)(x) | x["href"].rlike(place)
    rules |= {f"{rel} link": ~service | F.exists(links, is_(rel)) for rel in SERVICE_LINKS}
    rules |= {f"{rel} place": ~service | every(at(rel, place)) for rel, place in RECORD_PLACES.items()}
    if "path" in records.columns:
        named = (F.col("id") == file_stem("path")) & (~service | ((path_part("path", 2) == "records") & (path_part("path", 3) == F.col("id"))))
        rules["id is the file's name"] = named | (~service & (path_part("path", 1) == "record.json"))
    return _violations(records, ["id"], rules)


def branch_ref(href: Column | str) -> Column:
    """The branch that a raw file's address names with refs/heads/, else empty."""
    return F.regexp_extract(href, r"//raw\.githubusercontent\.com/.*/refs/heads/(.*?)/", 1)


def feature_branch(href: Column | str, own: Sequence[str] = ()) -> Column:
    """Whether an address of a raw file names a branch other than main and master: after refs/heads/ in any repository, in the short form in one's own (`owner/name`), where commits are allowed too."""
    named = branch_ref(href)
    found = (named != "") & ~named.isin("main", "master")
    for repository in own:
        short = F.regexp_extract(href, rf"//raw\.githubusercontent\.com/{repository}/(.*?)/", 1)
        found = found | (short != "") & ~short.isin("main", "master", "refs") & ~short.rlike("^[0-9a-f]+$")
    return found


def file_page(href: Column | str) -> Column:
    """Whether an address is a page that shows a file, not the file."""
    return F.lower(href).rlike("^https://github\\.com/.*/blob/")


def lint_scenarios(scenarios: DataFrame, backends: Sequence[str], own: Sequence[str] = ()) -> DataFrame:
    """backends: patterns of which one must fit the whole backend; own: see feature_branch(). Namespaces that aren't https addresses are names."""
    nodes = F.map_values("process_graph")
    graph, service = F.equal_null("type", F.lit("openeo")), F.equal_null("type", F.lit("ogc_api_process"))
    of = lambda kind, rule: F.when(kind, rule).otherwise(F.lit(True))
    fine = lambda name: name.isNull() | ~name.startswith("https://") | ~file_page(name) & ~feature_branch(name, own)
    rules = {
        "id": F.col("id").rlike(SCENARIO_ID),
        "type": graph | service,
        "backend": of(graph, F.col("backend").rlike("^(?:" + "|".join(backends) + ")$") if backends else F.lit(False)),
        "process graph": of(graph, F.size(nodes) > 0),
        "process id": of(graph, F.forall(nodes, lambda n: n["process_id"].rlike(PROCESS_ID))),
        "arguments": of(graph, F.forall(nodes, lambda n: n["arguments"].isNotNull())),
        "namespace": of(graph, F.forall(nodes, lambda n: fine(n["namespace"]))),
        "endpoint": of(service, F.col("endpoint").rlike("^https?://")),
        "application": of(service, F.length("application") > 0),
        "parameters": of(service, F.col("parameters").isNotNull()),
    }
    return _violations(scenarios, ["id"], rules)


def lint_links(links: DataFrame, href: str = "href", own: Sequence[str] = ()) -> DataFrame:
    """Links to code hosting that a later change would break: pages of files, and feature branches."""
    return _violations(links, [href], {"no file page": ~file_page(href), "no feature branch": ~feature_branch(href, own)})


def lint_process_defs(defs: DataFrame) -> DataFrame:
    known = F.col("parameters").isNotNull()
    rules = {
        "id is the file's name": F.col("id") == file_stem("path") if "path" in defs.columns else F.col("id").isNotNull(),
        "description": F.length("description") > 0,
        "parameters": known,
        "process graph": F.col("process_graph").isNotNull(),
        "parameter name": known & F.forall("parameters", lambda p: F.length(p["name"]) > 0),
        "parameter description": known & F.forall("parameters", lambda p: F.length(p["description"]) > 0),
        "parameter schema": known & F.forall("parameters", lambda p: p["schema"].contains('"type"')),
    }
    return _violations(defs, ["id"], rules)


def catalogue_cards(records: DataFrame) -> DataFrame:
    """What a catalogue shows of its public records."""
    p = lambda name: F.col(f"properties.{name}")
    profile = F.get(profiles(), F.lit(0))
    return records.where(F.coalesce(p("visibility"), F.lit("public")) == "public").select(
        "id", p("title").alias("title"), p("description").alias("description"), F.array_join(p("keywords"), ", ").alias("keywords"), profile.alias("profile"),
        *(link_of(r).alias(r) for r in ("thumbnail", "preview", "license", "order")), p("cost_estimate").alias("cost_estimate"), p("cost_unit").alias("cost_unit"),
        F.array_join(F.transform(p("formats"), lambda f: f["name"]), ", ").alias("formats"),
    )


def issue_labels(runs: DataFrame, phase: str = "failed_phase") -> DataFrame:
    made = F.array_compact(F.array(F.lit("benchmark"), F.when(F.col(phase).isNotNull(), F.concat(F.lit("benchmark-phase:"), F.col(phase)))))
    return runs.withColumn("labels", made)


def attach_contacts(scenarios: DataFrame, records: DataFrame) -> DataFrame:
    """Each scenario with the contacts of the first record (by path) beside it that has any."""
    folder = F.regexp_replace("path", r"/[^/]*/[^/]*$", "")
    known = records.where(F.size("properties.contacts") > 0).select(folder.alias("_folder"), "path", F.col("properties.contacts").alias("contacts"))
    first = known.groupBy("_folder").agg(F.min_by("contacts", "path").alias("contacts"))
    return scenarios.withColumn("_folder", folder).join(first, "_folder", "left").drop("_folder")


def attach_failure_logs(runs: DataFrame, logs: DataFrame, node: str = "nodeid") -> DataFrame:
    """Each run with the report section of its test's name."""
    key = F.element_at(F.split(F.col(node), "::"), -1)
    return runs.withColumn("_test", key).join(logs.select(F.col("section").alias("_test"), F.col("body").alias("log")), "_test", "left").drop("_test")


def triage(runs: DataFrame, scenarios: DataFrame, issues: DataFrame) -> DataFrame:
    """What to do for each run (scenario_id, outcome): create an issue, comment on each open one of its title, or none.

    Runs of unknown scenarios are left out; a scenario id that repeats is an error.
    """
    once = scenarios.groupBy("id").agg(F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("duplicate scenario: "), F.first("id"))).cast("string")).otherwise(F.first("id")).alias("_id")).select(F.col("_id").alias("scenario_id"))
    titled = runs.join(once, "scenario_id").withColumn("title", F.concat(F.lit("Scenario "), F.col("scenario_id"), F.lit(" failed")))
    joined = titled.join(issues.select("title", "number"), "title", "left")
    action = F.when(F.col("number").isNotNull(), "comment").when(F.col("outcome") == "failed", "create").otherwise("none")
    return joined.select("scenario_id", "outcome", "number", action.alias("action"))


def provider_coverage(folders: DataFrame, records: DataFrame) -> DataFrame:
    """Provider folders without a record.json."""
    have = records.where(path_part("path", 1) == "record.json").select(path_part("path", 2).alias("provider"))
    return folders.join(have, "provider", "left_anti")
