"""Which rule rewrites a detection: exact id, then module routing, then the first rule whose regex matches the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transmuta import schemas
from transmuta.functions.arrays import elements, once
from transmuta.functions.constants import built_once, constant_rows
from transmuta.functions.joins import may_be_member
from transmuta.sources.catalog import MAPPING_KEY, RuleSet

RULE_STRUCT = ("struct<rule_ord:int, key:string, id:string, pattern:string, replacement:string, confidence:string, type:string, "
               "framework:string, source:string, literal:string, named:boolean>")


@built_once
def rule_array(rules: RuleSet) -> Column:
    """The rule table as one array constant in JVM regex syntax."""
    return constant_rows(({
        "rule_ord": r.rule_ord, "key": r.key, "id": r.id, "pattern": r.jvm_pattern, "replacement": r.jvm_replacement,
        "confidence": r.confidence, "type": r.type, "framework": r.framework, "source": r.source, "literal": r.literal,
        "named": r.type == "class_inheritance" and "{name}" in r.replacement} for r in rules), RULE_STRUCT)


def matches(content: Column, rule: Column) -> Column:
    """Does the rule's regex occur in the text? A byte-level test for the literal part of the pattern comes first."""
    return content.contains(rule["literal"]) & F.rlike(content, rule["pattern"])


def first_with(entries: Column, field: str, value: Column) -> Column:
    """First rule whose field equals the value, NULL when there is none."""
    return F.get(F.filter(entries, lambda r: r[field] == value), F.lit(0))


def routed_key(module: Column) -> Column:
    """Catalogue key for an import of a known family, by the module's name."""
    part = F.split(module, r"\.")

    def has(*words):
        hit = F.lit(False)
        for w in words:
            hit = hit | module.contains(w)
        return hit

    agents = F.when(has("chat_completion", "ChatCompletionAgent", "AgentGroupChat"), "sk_import_chat_completion").when(
        has("KernelAgent", "kernel_agent"), "sk_import_agent").otherwise("sk_import_chat_completion")
    kernel = F.when(F.array_contains(part, "agents"), agents).when(
        F.array_contains(part, "functions"), "sk_import_functions").when(
        F.array_contains(part, "plugins"), "sk_import_plugins").otherwise("sk_import_kernel")
    chat = F.when(has("ConversableAgent"), "autogen_import_conversable").when(
        has("AssistantAgent"), "autogen_import_assistant").otherwise("autogen_import_conversable")
    return F.when(module.startswith("semantic_kernel"), kernel).when(module.startswith("autogen"), chat)


@built_once
def resolved_array(rules: RuleSet, detections: str = "detections", content: str = "content") -> Column:
    """detections -> array of struct(detection, rule, method); unresolved ones keep a NULL rule."""
    entries = rule_array(rules)
    text = F.col(content)

    def pick(d):
        searched = F.get(F.filter(entries, lambda r: (r["type"] == d["type"]) & (r["key"] != MAPPING_KEY) & matches(text, r)), F.lit(0))
        rule = F.coalesce(first_with(entries, "id", d["id"]), first_with(entries, "key", routed_key(d["module"])), searched)
        return F.struct(d.alias("detection"), rule.alias("rule"))

    def label(x):
        method = F.when(x["rule"]["id"] == x["detection"]["id"], "id").when(
            x["detection"]["module"].startswith("semantic_kernel") | x["detection"]["module"].startswith("autogen"), "module").otherwise("regex")
        return F.struct(x["detection"].alias("detection"), x["rule"].alias("rule"),
                        F.when(x["rule"]["id"].isNotNull(), method).alias("method"))

    return F.transform(F.transform(F.col(detections), pick), label)


def with_resolved(files: DataFrame, rules: RuleSet) -> DataFrame:
    """Files with detections plus a `resolved` array, all within the row."""
    return files.withColumn("resolved", resolved_array(rules))


def explode_resolved(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.explode(elements("resolved")).alias("x")).select(
        "repo", "path", "x.detection.*", F.col("x.rule.rule_ord").alias("rule_ord"), F.col("x.rule.id").alias("rule_id"),
        F.col("x.rule.confidence").alias("rule_confidence"), "x.method")


_FIELDS = ("det_seq", "id", "type", "module", "class", "confidence", "source", "line")


def _per_file(detections: DataFrame) -> DataFrame:
    """One row per file with its detections in order. A file is one row of the corpus, so its list is bounded by it."""
    return detections.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("detections"))


def attach_detections(files: DataFrame, detections: DataFrame) -> DataFrame:
    """Bring a detection table (such as a saved report) back to its files.

    The array per file is built first. A membership filter of the named files is tested in the scan: a file it rejects is not
    in the report and stays where it is, so only named files (and a few more that pass) are moved to the join.
    """
    keys = ["repo", "path"]
    none = F.array().cast(f"array<{schemas.DETECTION}>")
    named = may_be_member(detections, keys)
    joined = files.filter(named).join(_per_file(detections), keys, "left").withColumn("detections", F.coalesce("detections", none))
    return joined.unionByName(files.filter(~named).withColumn("detections", none))


def resolve_rule(detections: DataFrame, files: DataFrame, rules: RuleSet) -> DataFrame:
    """Table form: detection columns plus rule_ord, rule_id, rule_confidence and method.

    Ids and modules are resolved without touching any content. For the rest, each file's first matching rule per type
    is found in the scan; only that narrow table is joined, so no content is shuffled. A detection whose file is
    missing stays unresolved.
    """
    entries = rule_array(rules)
    by_id, by_module = first_with(entries, "id", F.col("id")), first_with(entries, "key", routed_key(F.col("module")))
    named = once(detections, _rule=F.struct(F.coalesce(by_id, by_module).alias("rule")))
    rule = F.col("_rule.rule")
    family = F.col("module").startswith("semantic_kernel") | F.col("module").startswith("autogen")
    direct = named.filter(rule.isNotNull()).select(
        "repo", "path", *_FIELDS, rule["rule_ord"].alias("rule_ord"), rule["id"].alias("rule_id"), rule["confidence"].alias("rule_confidence"),
        F.when(rule["id"] == F.col("id"), "id").otherwise("module").alias("method"))
    rest = named.filter(rule.isNull()).select("repo", "path", *_FIELDS)
    searched = first_matching_rule(files, RuleSet(tuple(r for r in rules if r.key != MAPPING_KEY)))
    found = rest.join(searched, ["repo", "path", "type"], "left").select(
        "repo", "path", *_FIELDS, "rule_ord", "rule_id", "rule_confidence",
        F.when(F.col("rule_id").isNotNull(), F.when(family, "module").otherwise("regex")).alias("method"))
    return direct.unionByName(found)


def first_matching_rule(files: DataFrame, rules: RuleSet) -> DataFrame:
    """Lowest rule_ord whose regex matches, per file and rule type."""
    from transmuta.operators.detect import matching_rules

    hits = files.select("repo", "path", matching_rules(F.col("content"), rules).alias("hits"))
    kinds = F.array_distinct(F.transform("hits", lambda h: h["type"]))
    first = F.transform(kinds, lambda t: F.get(F.filter("hits", lambda h: h["type"] == t), F.lit(0)))
    return hits.select("repo", "path", F.inline(first)).select(
        "repo", "path", "type", F.col("id").alias("rule_id"), "rule_ord", F.col("confidence").alias("rule_confidence"))


def codemod_plan(detections: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per detected id that names a rule; of several detections the last in input order wins."""
    last = detections.groupBy("id").agg(
        F.max_by(F.struct("repo", "path", "det_seq"), F.struct("repo", "path", "det_seq")).alias("last"),
        F.count("*").alias("n_detections"))
    plan = last.join(rules.select("id", "type", "confidence", "framework", "description"), "id")
    return plan.select(F.col("id").alias("pattern_id"), "type", "confidence", "framework", "description",
                       F.col("last.path").alias("last_path"), "n_detections")


def merge_plans(old: DataFrame, new: DataFrame, key: str = "pattern_id") -> DataFrame:
    """Right-biased union by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
