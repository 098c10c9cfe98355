"""Was every detection applied, and is the result in the output? Checks over a finished run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transmuta.functions.arrays import elements
from transmuta.functions.joins import salted_join
from transmuta.functions.materialize import cut
from transmuta.functions.pyre import jvm_pattern
from transmuta.operators.resolve import first_with, rule_array
from transmuta.sources.catalog import MAPPING_KEY, RuleSet


def run_table(rewritten: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """The narrow record of a run: detections with resolved ids, applied ids, the changed flag and, when rules are
    given, the output checks. No content.

    All checks read it, so the rewrite behind it runs once and its lineage ends here.
    """
    narrow = rewritten.select(
        "repo", "path", "applied", "changed",
        F.transform("resolved", lambda x: F.struct(x["detection"].alias("detection"), x["rule"]["id"].alias("rule_id"))).alias("resolved"),
        *([] if rules is None else [F.when(F.col("changed"), output_checks(rules)).alias("outputs")]))
    return cut(narrow)


def applied_ids(run: DataFrame) -> DataFrame:
    """Rule ids applied anywhere in a project: one row per project, at most one entry per rule of the catalogue."""
    distinct = run.select("repo", F.explode(elements("applied")).alias("id")).distinct()
    return distinct.groupBy("repo").agg(F.collect_set("id").alias("applied_ids"))


def application_membership(run: DataFrame) -> DataFrame:
    """Per high-confidence detection: is its id among the project's applied ids, is its rule's, was its file updated?"""
    rows = run.select("repo", "path", "changed", F.explode(elements("resolved")).alias("x")).select(
        "repo", "path", "x.detection.*", F.col("x.rule_id").alias("rule_id"), F.col("changed").alias("file_transformed"))
    rows = rows.filter((F.col("confidence") == "high") & (F.col("source") == "rule"))
    joined = salted_join(rows, applied_ids(run), ["repo"], "left", spread_by=["path"])

    def member(col):
        return F.coalesce(F.array_contains("applied_ids", F.col(col)), F.lit(False))

    return joined.select(
        "repo", "path", "det_seq", "id", F.coalesce("module", F.lit("unknown")).alias("module"), "rule_id",
        member("id").alias("applied"), member("rule_id").alias("rule_applied"), "file_transformed")


def application_mapping(membership: DataFrame) -> DataFrame:
    """One row per project and detected id; of several detections the last in input order wins."""
    order = F.struct("path", "det_seq")
    failed = ~F.col("applied") & ~F.col("file_transformed")
    return membership.groupBy("repo", "id").agg(
        F.max_by(F.struct("applied", "rule_applied", "file_transformed", "path", "module"), order).alias("last"),
        F.count("*").alias("n_detections"), F.count_if(failed).alias("n_failed"),
    ).select("repo", "id", "last.*", "n_detections", "n_failed", (F.col("n_failed") == 0).alias("mapping_complete"))


def failed_patterns(membership: DataFrame) -> DataFrame:
    """Detections that were neither applied nor in an updated file."""
    return membership.filter(~F.col("applied") & ~F.col("file_transformed")).select(
        "repo", "path", F.col("id").alias("pattern_id"), "module",
        F.lit("Pattern detected but not applied and file not transformed").alias("reason"))


def _checked_key(module: Column) -> Column:
    """Catalogue key used by the output check; narrower than the routing of the rewrite."""
    return (
        F.when(module.startswith("semantic_kernel"),
               F.when(module.contains("chat_completion") | module.contains("ChatCompletionAgent"), "sk_import_chat_completion")
               .when(module.contains("KernelAgent"), "sk_import_agent")
               .when(module.contains("plugins"), "sk_import_plugins")
               .when(module.contains("functions"), "sk_import_functions"))
        .when(module.startswith("autogen"),
              F.when(module.contains("ConversableAgent"), "autogen_import_conversable")
              .when(module.contains("AssistantAgent"), "autogen_import_assistant")))


def output_checks(rules: RuleSet) -> Column:
    """Checks of one file's high-confidence detections; before and after are columns of one row, so nothing is joined."""
    entries = rule_array(RuleSet(tuple(r for r in rules if r.key != MAPPING_KEY)))
    before, after = F.col("content"), F.col("new_content")

    def pick(d):
        rule = F.coalesce(first_with(entries, "id", d["id"]), first_with(entries, "key", _checked_key(d["module"])))
        return F.struct(d.alias("detection"), rule.alias("rule"))

    def expect(x):
        name = F.regexp_extract(before, jvm_pattern(r"class (\w+)\("), 1)
        # an escaped dollar of the replacement syntax is a plain one in the text
        text = F.replace(F.replace(x["rule"]["replacement"], F.lit("{name}"), name), F.lit(r"\$"), F.lit("$"))
        return F.struct(x["detection"].alias("detection"), x["rule"].alias("rule"), text.alias("expected"))

    def check(x):
        return F.struct(
            x["detection"].alias("detection"), x["rule"]["id"].alias("rule_id"), x["expected"].alias("expected_replacement"),
            F.rlike(before, x["rule"]["pattern"]).alias("in_before"), F.rlike(after, x["rule"]["pattern"]).alias("in_after"),
            after.contains(x["expected"]).alias("new_in_after"))

    wanted = F.filter("detections", lambda d: (d["confidence"] == "high") & (d["source"] == "rule"))
    return F.transform(F.transform(F.transform(wanted, pick), expect), check)


def output_mapping(rewritten: DataFrame, rules: RuleSet) -> DataFrame:
    """Per high-confidence detection in an updated file: did the old text go and the new text arrive?"""
    return output_rows(rewritten.filter("changed").select("repo", "path", output_checks(rules).alias("outputs")))


def output_rows(checked: DataFrame) -> DataFrame:
    """One row per output check with its status."""
    rows = checked.select("repo", "path", F.explode(elements("outputs")).alias("x"))
    x = F.col("x")
    status = (
        F.when(x["rule_id"].isNull(), "error")
        .when(x["in_before"] & x["in_after"] & x["new_in_after"], "partial")
        .when(x["in_before"] & x["new_in_after"], "success")
        .when(x["in_before"], "failed")
        .when(x["new_in_after"], "success")
        .otherwise("not_found_in_original"))
    error = (
        F.when(x["rule_id"].isNull(), "Pattern definition not found")
        .when(x["in_before"] & ~x["in_after"] & ~x["new_in_after"], "Pattern removed but replacement not found")
        .when(x["in_before"] & x["in_after"] & ~x["new_in_after"], "Pattern still present but replacement not found")
        .when(~x["in_before"] & ~x["new_in_after"], "Pattern detected but not found in original file"))
    return rows.select(
        "repo", "path", F.col("x.detection.det_seq").alias("det_seq"), F.col("x.detection.id").alias("pattern_id"),
        F.col("x.detection.module").alias("module"), "x.rule_id", status.alias("status"), "x.in_before", "x.in_after",
        "x.new_in_after", "x.expected_replacement", error.alias("error"))


def combined_failures(membership: DataFrame, outputs: DataFrame) -> DataFrame:
    """Failed applications and failed outputs as one bag."""
    bad = outputs.filter(F.col("status") == "failed").select("repo", "path", "pattern_id", "module", "status", "error")
    return failed_patterns(membership).unionByName(bad, allowMissingColumns=True)


def mapping_report(rewritten: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per project: counts, rates and completeness."""
    run = run_table(rewritten, rules)
    outputs = output_rows(run).groupBy("repo").agg(
        F.count("*").alias("outputs"), F.count_if(F.col("status") == "success").alias("successful_outputs"),
        F.count_if(F.col("status") == "failed").alias("failed_outputs"))
    mapping = application_mapping(application_membership(run)).groupBy("repo").agg(
        F.count("*").alias("mapped_ids"), F.sum("n_detections").alias("high_confidence_patterns"),
        F.sum("n_failed").alias("failed_applications"))
    totals = run.groupBy("repo").agg(
        F.sum(F.size("resolved")).alias("patterns_detected"), F.sum(F.size("applied")).alias("patterns_applied"),
        F.count_if("changed").alias("files_transformed"))
    joined = totals.join(mapping, "repo", "left").join(outputs, "repo", "left").na.fill(0)
    return joined.select(
        "repo", "patterns_detected", "high_confidence_patterns", "patterns_applied", "files_transformed",
        F.when(F.col("mapped_ids") > 0, F.col("patterns_applied") / F.col("mapped_ids")).otherwise(0.0).alias("pattern_application_rate"),
        F.when(F.col("outputs") > 0, F.col("successful_outputs") / F.col("outputs")).otherwise(0.0).alias("transformation_success_rate"),
        "successful_outputs", (F.col("failed_applications") + F.col("failed_outputs")).alias("n_failures"),
        ((F.col("failed_applications") == 0) & (F.col("failed_outputs") == 0)).alias("mapping_complete"))


def checkpoint_counts(rewritten: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Checkpoint of a run per project: updated and failed files, applied rules, total."""
    done = rewritten.groupBy("repo").agg(
        F.count_if("changed").alias("updated_files"), F.sum(F.size("applied")).alias("patterns_applied"))
    if failed is None:
        out = done.withColumn("failed_files", F.lit(0).cast("long"))
    else:
        out = done.join(failed.groupBy("repo").agg(F.count("*").alias("failed_files")), "repo", "full").na.fill(0)
    return out.select("repo", "updated_files", "failed_files", "patterns_applied",
                      (F.col("updated_files") + F.col("failed_files")).alias("total_files"))


def run_status(rewritten: DataFrame) -> DataFrame:
    """A run fails without a high-confidence detection or without a changed file."""
    high = F.size(F.filter("detections", lambda d: (d["confidence"] == "high") & (d["source"] == "rule")))
    counts = rewritten.groupBy("repo").agg(F.sum(high).alias("high_confidence"), F.count_if("changed").alias("changed_files"))
    status = F.when((F.col("high_confidence") == 0) | (F.col("changed_files") == 0), "failed").otherwise("completed")
    return counts.withColumn("status", status)
