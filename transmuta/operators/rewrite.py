"""The rewrite: an ordered fold of regex rules over each file, inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transmuta.functions import text
from transmuta.functions.arrays import elements, once
from transmuta.functions.constants import built_once
from transmuta.functions.pyre import jvm_pattern, jvm_replacement
from transmuta.operators import detect, resolve
from transmuta.sources.catalog import RuleSet


def gated(resolved: Column, mode: str = "auto") -> Column:
    """Rules to apply, in detection order. Auto mode needs a high-confidence detection and a high-confidence rule."""
    # a rule that states no replacement only detects
    keep = F.filter(resolved, lambda x: x["rule"]["id"].isNotNull() & (x["rule"]["replacement"] != ""))
    if mode == "auto":
        keep = F.filter(keep, lambda x: (x["detection"]["confidence"] == "high") & (x["detection"]["source"] == "rule")
                        & (x["rule"]["confidence"] == "high"))
    elif mode != "review":
        raise ValueError(f"unknown mode: {mode}")
    return F.transform(keep, lambda x: x["rule"])


def fold(content: Column, to_apply: Column) -> Column:
    """Apply rules one after another to the text; returns struct(content, applied ids).

    A `{name}` template takes the name of the first class in the text as rewritten so far.
    """
    start = F.struct(content.alias("content"), F.array().cast("array<string>").alias("applied"))

    def step(acc, r):
        current = acc["content"]
        name = F.regexp_extract(current, jvm_pattern(r"class (\w+)\("), 1)
        replacement = F.when(r["named"] & (name != ""), F.replace(r["replacement"], F.lit("{name}"), name)).otherwise(r["replacement"])
        return F.when(resolve.matches(current, r), F.struct(
            F.regexp_replace(current, r["pattern"], replacement).alias("content"),
            F.concat(acc["applied"], F.array(r["id"])).alias("applied"))).otherwise(acc)

    return F.aggregate(to_apply, start, step)


@built_once
def _folded(mode: str) -> Column:
    return fold(F.col("content"), gated(F.col("resolved"), mode))


def rewrite(files: DataFrame, rules: RuleSet, mode: str = "auto", per_match: bool = False, resolved: bool = False) -> DataFrame:
    """files(detections) -> files + new_content, applied, changed. One narrow pass, no shuffle.

    `per_match` binds class templates to each matched class instead of the first one in the file.
    """
    rules = rules.per_match() if per_match else rules
    ready = files if resolved else resolve.with_resolved(files, rules)
    out = once(ready, _fold=_folded(mode))
    return out.withColumns({
        "new_content": F.col("_fold.content"),
        "applied": F.col("_fold.applied"),
        "changed": ~F.col("_fold.content").eqNullSafe(F.col("content")),
    }).drop("_fold")


def migrate(files: DataFrame, rules: RuleSet, mode: str = "auto", outlier_mode: str | None = None,
            per_match: bool = False, limits=None) -> DataFrame:
    """detect -> resolve -> gate -> rewrite for a file table."""
    found = detect.with_detections(files)
    if outlier_mode in ("cautious", "review"):
        from transmuta.functions.facts import with_facts
        from transmuta.operators.outliers import Limits, file_reasons

        found = detect.with_detections(with_facts(text.with_line_shape(files, (limits or Limits()).indent_lines)), parsed=True)
        found = once(found, _reasons=file_reasons(limits or Limits())).filter(F.size("_reasons") == 0)
        found = found.drop("_reasons", "n_lines", "is_mixed")
    return rewrite(found, rules, mode, per_match)


def applied_rules(rewritten: DataFrame) -> DataFrame:
    """One row per applied rule and file, in order of application."""
    return rewritten.select("repo", "path", F.posexplode(elements("applied")).alias("apply_seq", "rule_id"))


def confidence_gate(resolved_rows: DataFrame) -> DataFrame:
    """Detections that auto mode may apply."""
    return detect.high_confidence(resolved_rows).filter(F.col("rule_confidence") == "high")


def changed_files(rewritten: DataFrame, output_dir: str | None = None) -> DataFrame:
    """Changed files with the path they are written to: in place, or below an output directory."""
    rel = text.relative(F.col("repo"), F.col("path"))
    target = F.concat(F.lit(output_dir.rstrip("/") + "/"), F.col("repo"), F.lit("/"), rel) if output_dir else F.col("path")
    return rewritten.filter("changed").withColumn("target_path", target)


def write_changed(rewritten: DataFrame, out: str, output_dir: str | None = None) -> None:
    """Write changed files as Parquet partitioned by project; only they are shuffled, balanced by size per project."""
    (changed_files(rewritten, output_dir).select("repo", "path", "target_path", F.col("new_content").alias("content"))
     .hint("rebalance", F.col("repo")).write.mode("overwrite").partitionBy("repo").parquet(out))


def split_failures(files: DataFrame, policy: str = "continue") -> tuple[DataFrame, DataFrame]:
    """(usable files, failed rows). A file fails when its bytes could not be read as text.

    With `stop` the first failed file ends the job; with `continue` failures go to a side table and are never retried.
    """
    error = F.lit("content is not valid UTF-8")
    if policy == "stop":
        checked = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("failed: "), F.col("path"), F.lit(": "), error))
                         ).otherwise(F.col("content")).alias("content")
        rest = [c for c in files.columns if c != "content"]
        return files.select(*rest, checked), files.limit(0).select("repo", "path")
    failed = files.filter(F.col("content").isNull()).select(
        "repo", "path", error.alias("error"), F.lit(None).cast("string").alias("pattern_id"),
        F.lit(True).alias("requires_manual_review"), F.lit(False).alias("auto_retry"))
    return files.filter(F.col("content").isNotNull()), failed


# fixed values: the clean-up codemod (gates, rewrite, and the import line it needs)
CLEANUP_GATES = ("shutil.rmtree(temp_dir)", "shutil.rmtree(repo)")
CLEANUP_PATTERN = r"shutil\.rmtree\((temp_dir|repo|fixture|git_repo[_\w]*)\)"
CLEANUP_REPLACEMENT = r"safe_rmtree(\1)"
CLEANUP_ANCHOR = "import shutil"
CLEANUP_IMPORT = "from tests.utils.cleanup import safe_rmtree"
# fixed values: the missing-analysis codemod
ANALYSIS_PATTERN = r"(orchestrator\s*=\s*Orchestrator\([^)]+\))\s*\n\s*(orchestrator\.run_apply_auto\(\))"
ANALYSIS_REPLACEMENT = r"\1\n        orchestrator.run_analysis()\n        \2"


def backref_codemod(files: DataFrame, pattern: str, replacement: str, gates: tuple[str, ...] = (),
                    anchor: str | None = None, import_line: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Regex rewrite with group references on gated files; adds an import line after the first anchor when missing.

    `targets(repo, path)` limits the rewrite to a file list. Returns files + new_content, changed.
    """
    gate = F.lit(not gates)
    for g in gates:
        gate = gate | F.col("content").contains(g)
    base = files if targets is None else files.join(targets.distinct(), ["repo", "path"], "left_semi")
    source = F.col("content")
    if anchor and import_line:
        at = F.instr(source, anchor)
        spliced = F.concat(F.substring(source, F.lit(1), at + (len(anchor) - 1)), F.lit("\n" + import_line),
                           F.substring(source, at + len(anchor), F.length(source)))
        source = F.when((at > 0) & ~source.contains(import_line), spliced).otherwise(source)
    replaced = F.regexp_replace(source, jvm_pattern(pattern), jvm_replacement(replacement, pattern))
    out = base.withColumn("new_content", F.when(gate, replaced).otherwise(F.col("content")))
    return out.withColumn("changed", ~F.col("new_content").eqNullSafe(F.col("content")))
