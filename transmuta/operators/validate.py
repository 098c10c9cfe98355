"""Validation of a file table: syntax errors and unresolved imports as issue rows, and their summaries."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from transmuta.functions.constants import built_once, constant_table
from transmuta.functions.facts import with_facts
from transmuta.functions.joins import salted_join

LEVELS = ("error", "warning", "info")
_ISSUE = ("array<struct<level:string, line_no:int, col_no:int, error_type:string, message:string, context:string, "
          "top_module:string>>")


def builtin_or_known(spark: SparkSession, known: DataFrame) -> DataFrame:
    """Interpreter built-ins and the known-modules table, each module once."""
    builtin = constant_table(spark, [(m,) for m in sys.builtin_module_names], "module string")
    return builtin.union(known.select("module")).distinct()


def imported_modules() -> Column:
    """(module, line) of every import of a parsed file that is not relative by name."""
    facts = F.col("facts")
    plain = F.transform(facts["imports"], lambda i: F.struct(i["name"].alias("module"), i["line"].alias("line")))
    frm = F.transform(F.filter(facts["from_imports"], lambda i: i["module"] != ""),
                      lambda i: F.struct(i["module"].alias("module"), i["line"].alias("line")))
    return F.filter(F.concat(plain, frm), lambda m: ~m["module"].startswith("."))


@built_once
def issue_candidates() -> Column:
    """Issues of one file; import rows carry the module to look up and are issues only if it is unknown."""
    facts = F.col("facts")
    none = F.lit(None)
    broken = F.array(F.struct(
        F.lit("error").alias("level"), facts["err_line"].alias("line_no"), facts["err_col"].alias("col_no"),
        facts["err_type"].alias("error_type"),
        F.when(facts["err_type"] == "ParseError", F.concat(F.lit("Error parsing file: "), facts["err_msg"]))
        .otherwise(facts["err_msg"]).alias("message"),
        facts["err_text"].alias("context"), none.cast("string").alias("top_module")))
    unreadable = F.array(F.struct(
        F.lit("error").alias("level"), none.cast("int").alias("line_no"), none.cast("int").alias("col_no"),
        F.lit("ReadError").alias("error_type"), F.lit("Error reading file: content is not valid UTF-8").alias("message"),
        none.cast("string").alias("context"), none.cast("string").alias("top_module")))
    looked_up = F.transform(imported_modules(), lambda m: F.struct(
        F.lit("warning").alias("level"), m["line"].alias("line_no"), none.cast("int").alias("col_no"),
        F.lit("ImportWarning").alias("error_type"),
        F.concat(F.lit("Cannot resolve import: "), m["module"]).alias("message"),
        none.cast("string").alias("context"), F.substring_index(m["module"], ".", 1).alias("top_module")))
    return (F.when(facts.isNull(), unreadable.cast(_ISSUE)).when(facts["parse_ok"], looked_up.cast(_ISSUE))
            .otherwise(broken.cast(_ISSUE)))


def validate(files: DataFrame, known_modules: DataFrame, parsed: bool = False) -> DataFrame:
    """Issue rows. Imports are checked only in files that parse."""
    ready = files if parsed else with_facts(files)
    rows = ready.select("repo", "path", F.inline(issue_candidates()))
    known = builtin_or_known(files.sparkSession, known_modules).withColumnRenamed("module", "top_module")
    return salted_join(rows, known, ["top_module"], "left_anti", spread_by=["path"]).drop("top_module")


def unresolved_imports(files: DataFrame, known_modules: DataFrame) -> DataFrame:
    """The import warnings alone."""
    return validate(files, known_modules).filter(F.col("error_type") == "ImportWarning")


def level_rank(level: Column) -> Column:
    return F.when(level == "error", 0).when(level == "warning", 1).otherwise(2)


def all_issues(issues: DataFrame) -> DataFrame:
    """Every issue with its rank: errors, then warnings, then info."""
    return issues.withColumn("level_rank", level_rank(F.col("level")))


def issue_string(issues: DataFrame) -> DataFrame:
    """`[LEVEL] path:line:col - type: message`; the column is shown only with a line."""
    line = F.when(F.coalesce("line_no", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("line_no"))).otherwise("")
    col = F.when((line != "") & (F.coalesce("col_no", F.lit(0)) != 0), F.concat(F.lit(":"), F.col("col_no"))).otherwise("")
    return issues.withColumn("text", F.concat(
        F.lit("["), F.upper("level"), F.lit("] "), F.col("path"), line, col, F.lit(" - "), F.col("error_type"), F.lit(": "),
        F.col("message")))


def file_results(issues: DataFrame) -> DataFrame:
    """Counts per file that has issues."""
    return issues.groupBy("repo", "path").agg(
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
        F.count_if(F.col("level") == "info").alias("info"),
        F.bool_or((F.col("level") == "error") & F.lower("error_type").contains("syntax")).alias("syntax_hit"),
        F.bool_or(F.col("level").isin("error", "warning") & F.lower("error_type").contains("import")).alias("import_hit"))


def validation_summary(issues: DataFrame, files: DataFrame) -> DataFrame:
    """One row per project. `files` is only counted, so its content is never read here."""
    per_repo = file_results(issues).groupBy("repo").agg(
        F.count_if(F.col("errors") > 0).alias("invalid_files"), F.sum("errors").alias("total_errors"),
        F.sum("warnings").alias("total_warnings"), F.sum("info").alias("total_info"))
    totals = files.groupBy("repo").agg(F.count("*").alias("total_files"))
    joined = totals.join(per_repo, "repo", "left").na.fill(0)
    valid = F.col("total_files") - F.col("invalid_files")
    return joined.select(
        "repo", "total_files", valid.alias("valid_files"), "invalid_files",
        F.when(F.col("total_files") > 0, valid / F.col("total_files") * 100).otherwise(0.0).alias("success_rate"),
        "total_errors", "total_warnings", "total_info")


def metrics_from_validation(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Counters from validation results: at most one syntax and one import hit per invalid file.

    `files_with_import_errors` looks at invalid files only; `files_with_import_issues` looks at all of them.
    """
    hits = file_results(issues)
    per_repo = hits.groupBy("repo").agg(
        F.count_if((F.col("errors") > 0) & F.col("syntax_hit")).alias("files_with_syntax_errors"),
        F.count_if((F.col("errors") > 0) & F.col("import_hit")).alias("files_with_import_errors"),
        F.count_if("import_hit").alias("files_with_import_issues"))
    totals = files.groupBy("repo").agg(F.count("*").alias("files_analyzed"))
    return totals.join(per_repo, "repo", "left").na.fill(0).withColumn("files_transformed", F.col("files_analyzed"))


def unknown_imports(known: Sequence[str]) -> Column:
    """Number of a file's imports outside a short list of modules, in the row."""
    names = sorted({*known, *sys.builtin_module_names})
    return F.coalesce(F.size(F.filter(imported_modules(), lambda m: ~F.substring_index(m["module"], ".", 1).isin(names))), F.lit(0))
