"""Outliers: unusual projects and files, flagged from paths, text and syntax facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from transmuta import schemas
from transmuta.functions import text
from transmuta.functions.arrays import elements, once
from transmuta.functions.facts import with_facts
from transmuta.functions.joins import lookup_join
from transmuta.functions.pyre import jvm_pattern
from transmuta.sources.corpus import SKIP_DIRS


@dataclass(frozen=True)
class Limits:
    """Thresholds; a value above (or, for the smallest project, below) its limit is an outlier."""

    max_lines: int = 10_000
    max_func_lines: int = 1_000
    max_nesting: int = 20
    max_depth: int = 10
    max_files: int = 10_000
    min_files: int = 5
    max_size_ratio: float = 1_000.0
    min_parts: int = 3
    indent_lines: int | None = None  # lines of a file looked at for mixed indentation, None for all


# fixed values: top-level names that mark generated code
GENERATED = ("generated", "build", "dist", "__pycache__", ".pytest_cache")
# fixed values: (outlier type, risk, recommendation); {n} is the number of files
ADVICE = [
    ("monorepo", "Multiple projects may have different migration requirements", "Consider migrating each project separately"),
    ("deep_nesting", "Deep nesting may cause path resolution issues", "Verify path handling for deeply nested files"),
    ("generated_code", "Generated code should not be migrated", "Exclude generated code directories from migration"),
    ("git_submodules", "Submodules may have different migration requirements", "Handle submodules separately"),
    ("namespace_packages", "Namespace packages require special handling", "Verify namespace package migration"),
    ("large_files", "{n} very large files (>10K lines) may cause performance issues", "Consider splitting large files before migration"),
    ("large_functions", "{n} files with very large functions (>1000 lines)", "Large functions may need manual review"),
    ("mixed_indentation", "{n} files with mixed indentation (tabs/spaces)", "Normalize indentation before migration"),
    ("encoding_issues", "{n} files with encoding issues", "Fix encoding issues before migration"),
    ("unusual_file_types", "{n} unusual file types (.pyi, .pyw) may need special handling", "Review unusual file types manually"),
    ("patterns_in_comments", "{n} files with patterns only in comments", "Verify pattern detection in these files"),
    ("very_large_codebase", "Very large codebase ({n} files) may cause performance issues", "Consider migrating in batches or using --output-dir"),
    ("very_small_codebase", "Very small codebase may not represent typical usage", "Verify migration completeness"),
    ("extreme_size_variation", "Extreme file size variations may affect migration consistency", "Review file size distribution"),
]
# fixed values: risk level by outlier type, the highest level present wins; any other type is low
RISK_LEVELS = [
    ("critical", ("very_large_codebase", "encoding_issues", "git_submodules")),
    ("high", ("monorepo", "large_files", "large_functions", "deep_nesting")),
    ("medium", ("mixed_indentation", "unusual_file_types", "patterns_in_comments")),
]
# fixed values: names whose mention is looked for
MENTIONS = (r"semantic[_\s]*kernel", r"autogen")


def comment_only_mentions(content: Column) -> Column:
    """A name occurs after '#' somewhere and is nowhere imported."""
    names = "|".join(MENTIONS)
    mentioned = content.rlike(jvm_pattern(f"#.*(?:{names})", ignore_case=True))
    imported = content.rlike(jvm_pattern(rf"(?:from|import)\s+(?:{names})", ignore_case=True))
    # every mention contains one of these words in lower case, whatever its spelling: a byte search before the regexes
    low = F.lower(content)
    return content.contains("#") & (low.contains("kernel") | low.contains("autogen")) & mentioned & ~imported


def _can_exceed(limits: Limits) -> Column:
    """Only files this accepts can have a too-long function or too-deep nesting, so only they are parsed."""
    content = F.col("content")

    def occurrences(word):
        return (F.octet_length(content) - F.octet_length(F.replace(content, F.lit(word), F.lit("")))) / len(word)

    definitions = occurrences("def") + occurrences("class")
    return (F.col("n_lines") > limits.max_func_lines) | (definitions > limits.max_nesting)


def _path_columns(limits: Limits) -> dict[str, Column]:
    """What a path says, and whether its file makes a namespace package."""
    rel = text.relative(F.col("repo"), F.col("path"))
    p = text.parts(rel)
    empty = (text.basename(rel) == "__init__.py") & (text.strip(F.col("content")) == "")
    return {"rel": rel, "is_py": F.col("path").endswith(".py"), "top_dir": F.when(F.size(p) > 1, p[0]), "depth": F.size(p) - 1, "is_generated": p[0].isin(*GENERATED),
            "is_gitmodules": rel == ".gitmodules", "is_namespace": F.coalesce(empty & (F.size(text.parts(F.col("path"))) > limits.min_parts), F.lit(False))}


def path_flags(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The part of `file_flags` that structure needs: no text is split, searched or parsed."""
    return files.select("repo", "path", *[c.alias(n) for n, c in _path_columns(limits).items()])


def file_flags(files: DataFrame, limits: Limits = Limits(), skip: Sequence[str] = SKIP_DIRS, with_detections: bool = False) -> DataFrame:
    """Per-file measurements without the content. NULL content means the bytes were not UTF-8.

    `with_detections` adds the file's uses and whether the scan selects it, from the same parse.
    """
    rel = text.relative(F.col("repo"), F.col("path"))
    measured = once(text.with_line_shape(files, limits.indent_lines), is_comment_only=comment_only_mentions(F.col("content"))).withColumns({
        "rel": rel,
        "is_py": F.col("path").endswith(".py"),
        "skipped": text.any_part(rel, skip),
    })
    seen = F.col("is_py") & ~F.col("skipped")
    may_matter = _can_exceed(limits)
    extra = []
    if with_detections:
        from transmuta.operators.detect import detection_array, may_use

        may_matter = may_matter | may_use()
        extra = [seen.alias("selected"), F.when(seen, detection_array()).otherwise(F.array().cast(f"array<{schemas.DETECTION}>")).alias("detections")]
    measured = with_facts(measured, seen & may_matter)

    def flag(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    # bytes that are not UTF-8 still have lines, read as latin-1, where the scan carries the bytes
    size_lines = F.col("n_lines") if "raw" not in files.columns else F.coalesce(
        "n_lines", F.when(F.col("content").isNull(), text.line_count(text.decode_with_fallback(F.col("raw")))))
    return measured.select(
        "repo", "path", "n_lines", size_lines.alias("size_lines"), *extra,
        *[c.alias(n) for n, c in _path_columns(limits).items()],
        flag(seen & (F.col("n_lines") > limits.max_lines)).alias("large_files"),
        flag(seen & F.col("is_mixed")).alias("mixed_indentation"),
        flag(seen & F.col("content").isNull()).alias("encoding_issues"),
        flag(seen & (F.col("facts.max_func_lines") > limits.max_func_lines)).alias("large_functions"),
        flag(seen & (F.col("facts.max_nesting") > limits.max_nesting)).alias("deep_nesting"),
        flag(~F.col("skipped") & text.suffix(F.col("path")).isin(".pyi", ".pyw")).alias("unusual_file_types"),
        flag(seen & F.col("is_comment_only")).alias("patterns_in_comments"))


CODE_TYPES = ("large_files", "mixed_indentation", "encoding_issues", "large_functions", "deep_nesting")
PATTERN_TYPES = ("unusual_file_types", "patterns_in_comments")


def repo_profile(flags: DataFrame, totals: Sequence[str] = ()) -> DataFrame:
    """Counts per project, of those flags that are given; `totals` are columns to be summed. Rows are first summed per top-level
    directory, which also makes directories distinct."""
    counted = [c for c in (*CODE_TYPES, *PATTERN_TYPES) if c in flags.columns]
    sizes = "size_lines" in flags.columns
    per_dir = flags.groupBy("repo", "top_dir").agg(
        F.bool_or("is_py").alias("has_py"), F.max("depth").alias("depth"),
        F.bool_or("is_generated").alias("is_generated"), F.bool_or("is_gitmodules").alias("is_gitmodules"),
        F.bool_or("is_namespace").alias("is_namespace"), F.count_if("is_py").alias("n_py"),
        *([F.max(F.when(F.col("is_py"), F.col("size_lines"))).alias("max_lines"), F.min(F.when(F.col("is_py"), F.col("size_lines"))).alias("min_lines")] if sizes else []),
        *[F.count_if(c).alias(c) for c in counted], *[F.sum(c).alias(c) for c in totals])
    return per_dir.groupBy("repo").agg(
        F.count_if(F.col("has_py") & ~F.col("top_dir").startswith(".")).alias("python_project_count"),
        F.max("depth").cast("long").alias("max_depth"),
        F.bool_or("is_generated").alias("generated_code"), F.bool_or("is_gitmodules").alias("git_submodules"),
        F.bool_or("is_namespace").alias("namespace_packages"), F.sum("n_py").alias("n_py"),
        *([F.max("max_lines").alias("max_lines"), F.min("min_lines").alias("min_lines")] if sizes else []),
        *[F.sum(c).alias(c) for c in (*counted, *totals)])


def structure_outliers(flags: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Project-level structure flags, from `path_flags` or `file_flags`."""
    return repo_profile(flags).select(
        "repo", "python_project_count", "max_depth", (F.col("python_project_count") > 1).alias("monorepo"),
        (F.col("max_depth") > limits.max_depth).alias("deep_nesting"), "generated_code", "git_submodules", "namespace_packages")


def code_outliers(flags: DataFrame) -> DataFrame:
    """Number of files per code-level outlier type and project."""
    return repo_profile(flags).select("repo", *CODE_TYPES)


def outlier_files(flags: DataFrame, types: Sequence[str] = CODE_TYPES) -> DataFrame:
    """The files behind the counts, one row per (file, type)."""
    hits = F.array_compact(F.array(*[F.when(F.col(t), F.lit(t)) for t in types]))
    return flags.select("repo", "path", "rel", F.explode(hits).alias("outlier_type"))


def pattern_outliers(flags: DataFrame) -> DataFrame:
    return repo_profile(flags).select("repo", *PATTERN_TYPES)


def size_outliers(flags: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Project size and the ratio of its longest to its shortest Python file."""
    return repo_profile(flags).select("repo", F.col("n_py").alias("total_files"), *_size_flags(limits))


def _size_flags(limits: Limits) -> list[Column]:
    ratio = F.when((F.col("max_lines") > 0) & (F.col("min_lines") > 0), F.col("max_lines") / F.col("min_lines"))
    return [(F.col("n_py") > limits.max_files).alias("very_large_codebase"), (F.col("n_py") < limits.min_files).alias("very_small_codebase"),
            ratio.alias("size_ratio"), F.coalesce(ratio > limits.max_size_ratio, F.lit(False)).alias("extreme_size_variation")]


def outlier_type_counts(flags: DataFrame, limits: Limits = Limits(), totals: Sequence[str] = ()) -> DataFrame:
    """Per project, its outlier types and how often each was recorded; deep paths and deep code add up.

    One aggregate over the files gives the profile, the sizes and the sums of the columns in `totals`.
    """
    wide = repo_profile(flags, totals).select("*", F.col("n_py").alias("total_files"), *_size_flags(limits))

    def once(cond):
        return F.when(cond, 1).otherwise(0).cast("long")

    counts = {
        "monorepo": once(F.col("python_project_count") > 1),
        "deep_nesting": once(F.col("max_depth") > limits.max_depth) + F.col("deep_nesting"),
        "generated_code": once(F.col("generated_code")), "git_submodules": once(F.col("git_submodules")),
        "namespace_packages": once(F.col("namespace_packages")),
        **{t: F.col(t) for t in (*CODE_TYPES, *PATTERN_TYPES) if t != "deep_nesting"},
        **{t: once(F.col(t)) for t in ("very_large_codebase", "very_small_codebase", "extreme_size_variation")},
    }
    # only deep folders carry a risk of their own; deep code is a type without advice
    advised = {"deep_nesting": F.col("max_depth") > limits.max_depth}
    rows = F.array(*[F.struct(F.lit(t).alias("outlier_type"), n.alias("n"), F.coalesce(advised.get(t, F.lit(True)), F.lit(False)).alias("advised")) for t, n in counts.items()])
    return wide.select("repo", "total_files", F.filter(rows, lambda r: r["n"] > 0).alias("types"), *totals)


def distinct_types(type_counts: DataFrame) -> DataFrame:
    """One row per project and outlier type with its risk and recommendation."""
    advice = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).alias("risk"), F.lit(a).alias("recommendation")) for t, r, a in ADVICE])
    rows = type_counts.select("repo", "total_files", F.inline(elements("types")))
    found = rows.withColumn("a", F.when(F.col("advised"), F.get(F.filter(advice, lambda x: x["t"] == F.col("outlier_type")), F.lit(0))))
    shown = F.when(F.col("outlier_type") == "very_large_codebase", F.col("total_files")).otherwise(F.col("n"))
    return found.select("repo", "outlier_type", F.col("n").alias("n_recorded"),
                        F.replace("a.risk", F.lit("{n}"), shown.cast("string")).alias("risk"), F.col("a.recommendation").alias("recommendation"))


def outlier_report(type_counts: DataFrame) -> DataFrame:
    """One row per project, with the totals it carries. Confidence grows by 0.2 per recorded type, duplicates included."""
    totals = [c for c in type_counts.columns if c not in ("repo", "total_files", "types")]
    names = F.transform("types", lambda r: r["outlier_type"])
    level = F.when(F.size("types") == 0, "none")
    for risk, members in RISK_LEVELS:
        level = level.when(F.arrays_overlap(names, F.array(*[F.lit(m) for m in members])), risk)
    total = F.aggregate("types", F.lit(0).cast("long"), lambda a, r: a + r["n"])
    return type_counts.select(
        "repo", (F.size("types") > 0).alias("is_outlier"), F.array_join(F.array_sort(names), ",").alias("outlier_types"),
        F.least(total * F.lit(0.2).cast("double"), F.lit(1.0).cast("double")).alias("confidence"), level.otherwise("low").alias("risk_level"), *totals)


def file_reasons(limits: Limits = Limits()) -> Column:
    """Reasons why one file is unusual, from its content, line shape and `facts` column; empty when it is not."""
    n = F.col("n_lines")
    facts = F.col("facts")
    depth = facts["max_nesting"]
    reasons = F.array_compact(F.array(
        F.when(n > limits.max_lines, F.concat(F.lit("Very large file ("), n, F.lit(" lines)"))),
        F.when(F.col("is_mixed"), F.lit("Mixed indentation (tabs and spaces)")),
        F.when(depth > limits.max_nesting, F.concat(F.lit("Deep nesting ("), depth, F.lit(" levels)"))),
        F.when(facts["err_type"] == "SyntaxError", F.lit("Syntax errors detected"))))
    return F.when(F.col("content").isNull(), F.array(F.lit("Cannot analyze file: content is not valid UTF-8"))).otherwise(reasons)


def file_outlier_reasons(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Unusual Python files with their reasons; other files are not parsed."""
    files = files.filter(F.col("path").endswith(".py"))
    found = once(with_facts(text.with_line_shape(files, limits.indent_lines)), reasons=file_reasons(limits))
    return found.filter(F.size("reasons") > 0).select("repo", "path", "reasons")


def outlier_gate(changes: DataFrame, reasons: DataFrame, mode: str | None) -> DataFrame:
    """In cautious and review mode unusual files are left out; otherwise nothing is."""
    if mode not in ("cautious", "review"):
        return changes
    return changes.join(reasons.select("repo", "path"), ["repo", "path"], "left_anti")


def repo_policy(report: DataFrame, choice: str = "cautious") -> DataFrame:
    """What to do with each project: unusual ones follow the choice, the others proceed. `abort` ends the run."""
    if choice not in ("cautious", "review", "expert", "abort"):
        raise ValueError(f"unknown policy: {choice}")
    return report.select("repo", F.when(F.col("is_outlier"), F.lit(choice)).otherwise("proceed").alias("policy"))


def suffix_match(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files whose path equals or ends with a listed relative path of the same project.

    The theta condition becomes an equi-join on (repo, tail): what ends with a listed path also ends with a tail of it. A listed path
    with two or more slashes is found by its last two components, one with a single slash by its last, one without by its
    last 2^k characters, the largest power its length allows. A path has one tail for each of these kinds that its own project
    lists, most often one; it is found in a narrow row per project, where a project with most files is looked up in a
    broadcast of bounded size.
    """
    slashes = F.length("rel") - F.length(F.replace("rel", F.lit("/"), F.lit("")))
    short = F.when(F.length("rel") == 0, 0).otherwise(F.pow(F.lit(2), F.floor(F.log2(F.length("rel") + 0.5))))
    wanted = listed.select("repo", "rel").distinct().withColumn("kind", F.when(slashes > 1, -2).when(slashes == 1, -1).otherwise(short).cast("int"))

    def tail(path: Column, kind: Column) -> Column:
        return F.when(kind < 0, F.when(kind == -1, F.substring_index(path, "/", -1)).otherwise(F.substring_index(path, "/", -2))).otherwise(F.right(path, kind))

    kinds = wanted.groupBy("repo").agg(F.collect_set("kind").alias("kinds"))
    placed = lookup_join(files.select("repo", "path"), kinds, ["repo"], ["path"])
    tails = F.transform("kinds", lambda k: F.struct(k.alias("kind"), tail(F.col("path"), k).alias("tail")))
    keyed = placed.select("repo", "path", F.inline(tails))
    found = keyed.join(wanted.withColumn("tail", tail(F.col("rel"), F.col("kind"))), ["repo", "kind", "tail"])
    return found.filter(F.endswith("path", F.col("rel"))).select("repo", "path", "rel")
