"""Lints over test files. Lines stay an array in the file's row: no exploded line table, no window, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from transmuta.functions import text
from transmuta.functions.arrays import once
from transmuta.functions.constants import built_once, constant_table
from transmuta.functions.facts import with_facts
from transmuta.functions.materialize import cut
from transmuta.functions.pyre import jvm_pattern
from transmuta.sources.corpus import name_matches

# fixed values: weak assertions (pattern, description)
WEAK_PATTERNS = [
    (r"assert\s+len\([^)]+\)\s*>=\s*0", "Length >= 0 is always true"),
    (r"assert\s+len\([^)]+\)\s*>\s*-1", "Length > -1 is always true"),
    (r"assert\s+isinstance\([^,]+,\s*dict\)\s*$", "isinstance(dict) without value check"),
    (r"assert\s+isinstance\([^,]+,\s*list\)\s*$", "isinstance(list) without value check"),
    (r"assert\s+isinstance\([^,]+,\s*str\)\s*$", "isinstance(str) without value check"),
    (r"assert\s+isinstance\([^,]+,\s*int\)\s*$", "isinstance(int) without value check"),
    (r"assert\s+\w+\s+is\s+not\s+None\s*$", "Not None check without value verification"),
    (r"assert\s+\w+\s*$", "Boolean assertion without specific check"),
    (r"assert\s+\w+\.exit_code\s+in\s+\[0,\s*1\]", "Exit code check without outcome verification"),
    (r"assert\s+\w+\.returncode\s+==\s*0\s*$", "Return code 0 without outcome verification"),
    (r"assert\s+len\([^)]+\)\s*>=\s*\d+\s*$", "Length check without content verification"),
]
# fixed values: weak assertions with a fix (pattern, fix with {g} for group 1, rationale)
WEAK_FIXES = [
    (r"assert\s+len\(([^)]+)\)\s*>=\s*0", 'assert len({g}) > 0, "Expected items in {g}"',
     "Length >= 0 is always true; use > 0 to verify actual content"),
    (r"assert\s+isinstance\(([^,]+),\s*dict\)\s*$", 'assert isinstance({g}, dict) and len({g}) > 0, "Expected non-empty dict"',
     "isinstance checks only type, not value; add content verification"),
    (r"assert\s+isinstance\(([^,]+),\s*list\)\s*$", 'assert isinstance({g}, list) and len({g}) > 0, "Expected non-empty list"',
     "isinstance checks only type, not value; add content verification"),
    (r"assert\s+(\w+)\s+is\s+not\s+None\s*$", 'assert {g} is not None and {g} != "", "Expected valid {g}"',
     "Not None check without value verification; add value check"),
]
# fixed values: what marks a test as working on real projects
REAL_WORLD = ("clone_", "real_repo", "semantic-kernel", "autogen", "production", "actual_repo", "@pytest.mark.real_world",
              "test_real_world")
# fixed values: what marks a test body as checking outcomes
OUTCOME_WORDS = ("transformed", "updated", "written", "created", "modified", "generated", "files_transformed", "maf_code",
                 "verify_", "check_")
WINDOW_WORDS = ("verify", "check", "transformed", "updated", "written")
WINDOW_PATTERNS = (r"assert.*>\s*0", r"assert.*in\s+")
# fixed values: audit categories
CATEGORIES = {
    "weak_assertions": "Weak Assertions", "missing_real_world": "Missing Real-World Tests",
    "missing_outcome_verification": "Missing Outcome Verification", "poor_test_structure": "Poor Test Structure",
    "missing_error_messages": "Missing Assertion Error Messages", "synthetic_only": "Synthetic-Only Tests",
}
# fixed values: folders whose tests are counted
TEST_FOLDERS = ("unit", "integration", "e2e", "edge_cases", "outliers", "performance", "error_recovery", "transformation",
                "pattern_detection")

_ISSUE = ("array<struct<line_no:int, category:string, issue_type:string, severity:string, description:string, "
          "current_code:string, suggested_fix:string, rationale:string>>")


def _issue(line_no, category, issue_type, severity, description, code=None, fix=None, rationale=None) -> Column:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        lit(line_no).cast("int").alias("line_no"), F.lit(category).alias("category"), F.lit(issue_type).alias("issue_type"),
        F.lit(severity).alias("severity"), lit(description).cast("string").alias("description"),
        lit(code).cast("string").alias("current_code"), lit(fix).cast("string").alias("suggested_fix"),
        lit(rationale).cast("string").alias("rationale"))


def contains_any(col: Column, words: Sequence[str]) -> Column:
    """Any of the words occurs; one search for all of them."""
    return col.rlike("|".join(re.escape(w) for w in words))


def with_test_lines(files: DataFrame) -> DataFrame:
    """Test files with `raw_lines` and `test_lines`: number, raw text and trimmed text of every line."""
    tests = files.filter(name_matches(F.col("path"), "test_*.py"))
    split = once(tests, raw_lines=text.split_lines(F.col("content")))
    return once(split, test_lines=F.transform("raw_lines", lambda s, i: F.struct(
        (i + 1).alias("n"), s.alias("raw"), text.strip(s).alias("s"))))


def _code_lines() -> Column:
    """Lines that can hold an assertion: not a comment, mentioning assert."""
    return F.filter("test_lines", lambda x: x["s"].contains("assert") & ~x["s"].startswith("#"))


@built_once
def weak_issues() -> Column:
    """One issue per line and weak pattern."""
    return F.flatten(F.transform(_code_lines(), lambda x: F.array_compact(F.array(*[
        F.when(x["s"].rlike(jvm_pattern(p)), _issue(x["n"], "weak_assertions", "weak_assertion", "critical", d, x["s"]))
        for p, d in WEAK_PATTERNS])))).cast(_ISSUE)


@built_once
def weak_fix_issues() -> Column:
    """One issue per line and fixable pattern, with the fix built from the match's first group."""
    return F.flatten(F.transform(_code_lines(), lambda x: F.array_compact(F.array(*[
        F.when(x["s"].rlike(jvm_pattern(p)), _issue(
            x["n"], "weak_assertions", "weak_assertion_pattern", "critical",
            "Weak assertion that may not verify actual functionality", x["s"],
            F.replace(F.lit(fix), F.lit("{g}"), F.regexp_extract(x["s"], jvm_pattern(p), 1)), why))
        for p, fix, why in WEAK_FIXES])))).cast(_ISSUE)


@built_once
def missing_message_issues() -> Column:
    """Assertions without a message that are more than a bare name."""
    bare = jvm_pattern(r"assert\s+\w+\s*$")
    hits = F.filter("test_lines", lambda x: x["s"].startswith("assert ") & ~x["s"].contains(",") & ~x["s"].rlike(bare))
    return F.transform(hits, lambda x: _issue(
        x["n"], "missing_error_messages", "missing_error_message", "warning", "Assertion missing error message", x["s"],
        F.concat(x["s"], F.lit(', "Add descriptive error message"')), "Error messages help diagnose test failures quickly")).cast(_ISSUE)


@built_once
def real_world_issues() -> Column:
    """End-to-end and integration files that never touch a real project."""
    e2e, integration = F.col("path").contains("e2e"), F.col("path").contains("integration")
    missing = (e2e | integration) & ~contains_any(F.lower("content"), REAL_WORLD)
    label = F.when(e2e, "E2E").otherwise("Integration")
    row = _issue(0, "missing_real_world", "no_real_world_tests", "critical", F.concat(label, F.lit(" test file missing real-world tests")),
                 "N/A", "Add @pytest.mark.real_world test using actual repository",
                 "Real-world tests are mandatory for E2E and integration testing")
    return F.when(missing, F.array(row)).otherwise(F.array()).cast(_ISSUE)


@built_once
def unvalidated_issues() -> Column:
    """The quality monitor's form of the same finding."""
    missing = (F.col("path").contains("e2e") | F.col("path").contains("integration")) & ~contains_any(F.lower("content"), REAL_WORLD)
    # fixed values: issue type and text
    row = _issue(0, "missing_real_world", "missing_real_world", "critical", "E2E/Integration test missing real-world validation")
    return F.when(missing, F.array(row)).otherwise(F.array()).cast(_ISSUE)


@built_once
def scan_errors() -> Column:
    """A test file whose bytes are not text is reported, not passed over."""
    row = _issue(0, "scan_error", "scan_error", "warning", "Error scanning file: content is not valid UTF-8")
    return F.when(F.col("content").isNull(), F.array(row)).otherwise(F.array()).cast(_ISSUE)


def test_windows(width: int = 50) -> Column:
    """(n, head, body) of every line that starts a test: the line and the ones after it, up to `width` lines."""
    starts = F.filter("test_lines", lambda x: x["s"].startswith("def test_"))
    return F.transform(starts, lambda x: F.struct(
        x["n"].alias("n"), x["s"].alias("head"), F.array_join(F.slice("raw_lines", x["n"], F.lit(width)), "\n").alias("body")))


@built_once
def window_issues(width: int = 50) -> Column:
    """Tests whose following lines assert something but check no outcome."""
    def unchecked(w):
        verified = contains_any(F.lower(w["body"]), WINDOW_WORDS)
        for p in WINDOW_PATTERNS:
            verified = verified | w["body"].rlike(jvm_pattern(p))
        return w["body"].contains("assert") & ~verified

    return F.transform(F.filter(test_windows(width), unchecked), lambda w: _issue(
        w["n"], "missing_outcome_verification", "missing_outcome_verification", "warning",
        F.concat(F.lit("Test "), w["head"], F.lit(" may not verify actual outcomes")), w["head"])).cast(_ISSUE)


@built_once
def test_blocks() -> Column:
    """(n, head, body) of every test function, its body ending before the first line indented no deeper than it.

    For one indentation d, the lines that can end a block are the non-blank lines with at most d leading spaces, and
    a test at indentation d is itself such a line; so its block ends where the next one begins. That makes the
    segmentation linear in the number of lines for each indentation that occurs.
    """
    shaped = F.transform("test_lines", lambda x: F.struct(
        x["n"].alias("n"), x["s"].alias("s"), (x["s"] != "").alias("solid"),
        (F.length(x["raw"]) - F.length(F.ltrim(x["raw"], F.lit(text.PY_SPACE)))).alias("indent"),
        (F.length(x["raw"]) - F.length(F.ltrim(x["raw"]))).alias("spaces"),
        x["s"].startswith("def test_").alias("is_test")))
    size = F.size("test_lines")

    def blocks(lines):
        depths = F.array_distinct(F.transform(F.filter(lines, lambda x: x["is_test"]), lambda x: x["indent"]))

        def at(d):
            edges = F.filter(lines, lambda x: x["solid"] & (x["spaces"] <= d))
            following = F.concat(F.transform(F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 1, F.lit(0))), lambda x: x["n"]),
                                 F.array(size + 1))
            paired = F.zip_with(edges, following, lambda x, nxt: F.struct(
                x["n"].alias("n"), x["s"].alias("head"), nxt.alias("next"), (x["is_test"] & (x["indent"] == d)).alias("keep")))
            return F.transform(F.filter(paired, lambda p: p["keep"]), lambda p: F.struct(
                p["n"].alias("n"), p["head"].alias("head"),
                F.array_join(F.slice("raw_lines", p["n"], p["next"] - p["n"]), "\n").alias("body")))

        return F.flatten(F.transform(depths, at))

    # bind the shaped lines once: a one-element transform keeps them from being rebuilt for every depth
    return F.flatten(F.transform(F.array(shaped), blocks))


@built_once
def block_issues() -> Column:
    """Test functions that assert something but mention no outcome."""
    hits = F.filter(test_blocks(), lambda b: b["body"].contains("assert") & ~contains_any(F.lower(b["body"]), OUTCOME_WORDS))
    return F.transform(hits, lambda b: _issue(
        b["n"], "missing_outcome_verification", "no_outcome_verification", "warning", "Test may not verify actual outcomes",
        b["head"], "Add assertions that verify actual transformation outcomes",
        "Tests must verify functionality works, not just that code runs")).cast(_ISSUE)


@built_once
def empty_test_issues() -> Column:
    """Test functions whose body is a single pass."""
    empty = F.filter(F.col("facts")["functions"], lambda f: f["only_pass"] & ~f["is_async"] & f["name"].startswith("test_"))
    rows = F.transform(empty, lambda f: _issue(
        f["line"], "poor_test_structure", "empty_test", "critical", "Empty test function",
        F.concat(F.lit("def "), f["name"], F.lit("():\n    pass")), "Remove or implement test",
        "Empty tests provide no value and mislead test coverage"))
    return F.coalesce(rows.cast(_ISSUE), F.array().cast(_ISSUE))


def issues(files: DataFrame, *parts: Column, parse: bool = False) -> DataFrame:
    """Issue rows of test files from any of the array builders above, in one pass."""
    ready = with_test_lines(files)
    ready = with_facts(ready, F.col("content").contains("pass")) if parse else ready
    return ready.select("repo", "path", F.inline(F.concat(*(F.coalesce(p, F.array().cast(_ISSUE)) for p in parts))))


def audit(files: DataFrame) -> DataFrame:
    """All audit issues of test files."""
    return issues(files, empty_test_issues(), weak_fix_issues(), missing_message_issues(), real_world_issues(), block_issues(), parse=True)


def monitor(files: DataFrame) -> DataFrame:
    """All quality-monitor issues of test files."""
    return issues(files, weak_issues(), unvalidated_issues(), window_issues(), scan_errors())


def function_blocks(files: DataFrame) -> DataFrame:
    return with_test_lines(files).select("repo", "path", F.inline(test_blocks()))


def assertion_stats(files: DataFrame) -> DataFrame:
    """Per project: test files, test functions, assert statements, and lines that mention assert."""
    ready = with_facts(with_test_lines(files))
    tests = F.filter(F.col("facts")["functions"], lambda f: ~f["is_async"] & f["name"].startswith("test_"))
    return ready.groupBy("repo").agg(
        F.count("*").alias("total_files"), F.sum(F.size(tests)).alias("total_tests"),
        F.sum(F.col("facts")["asserts"]).cast("long").alias("tree_assertions"), F.sum(F.size(_code_lines())).alias("line_assertions"))


def issue_counts(found: DataFrame, categories: Sequence[str] = tuple(CATEGORIES)) -> DataFrame:
    """(repo, grouping, name, n): a project's issues per category with zeros, and per severity, from one scan."""
    rows = found.select("repo", F.explode(F.array(
        F.struct(F.lit("category").alias("grouping"), F.col("category").alias("name")),
        F.struct(F.lit("severity").alias("grouping"), F.col("severity").alias("name")))).alias("x")).groupBy("repo", "x").agg(F.count("*").alias("n"))
    zeros = rows.select("repo").distinct().withColumn("x", F.explode(F.array(*[F.struct(F.lit("category").alias("grouping"), F.lit(c).alias("name")) for c in categories]))) \
        .withColumn("n", F.lit(0).cast("long"))
    return rows.unionByName(zeros).groupBy("repo", "x.grouping", "x.name").agg(F.sum("n").alias("n"))


def topk_issues(found: DataFrame, limits: dict[str, int], by: Sequence[str] = ("repo", "category", "severity")) -> DataFrame:
    """The first k issues of each group in path and line order, with the number left out.

    `row_number() <= k` keeps k rows per group in every map task before the shuffle; the group sizes come from a
    separate partial aggregate, so no group is ever gathered whole. Both read the issues from one written table.
    """
    widest = max(limits.values())
    found = cut(found)
    w = Window.partitionBy(*by).orderBy("path", "line_no", "description", "current_code")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= widest)
    k = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("severity")]
    sizes = found.groupBy(*by).agg(F.count("*").alias("n_group"))
    return ranked.filter(F.col("rank") <= k).join(sizes, list(by)).withColumn("n_more", F.greatest(F.col("n_group") - k, F.lit(0)))


def quality_verdict(found: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Per project FAIL with critical issues, WARN with warnings, else PASS; projects(repo) adds those without issues."""
    def n(severity):
        return F.count_if(F.col("severity") == severity)

    counts = found.groupBy("repo").agg(n("critical").alias("critical"), n("warning").alias("warnings"))
    if projects is not None:
        zero = F.lit(0).cast("long")
        rest = projects.select("repo").distinct().join(counts, "repo", "left_anti").select("repo", zero.alias("critical"), zero.alias("warnings"))
        counts = counts.unionByName(rest)
    return counts.withColumn("verdict", F.when(F.col("critical") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def test_inventory(files: DataFrame, folders: Sequence[str] = TEST_FOLDERS) -> DataFrame:
    """Tests per file, per folder and per project; folder totals of zero are left out."""
    p = text.parts(F.col("path"))
    after_tests = F.try_element_at(p, (F.array_position(p, "tests") + 1).cast("int"))
    folder = F.when(F.array_contains(p, "tests") & after_tests.isin(*folders), after_tests)
    n = F.regexp_count("content", F.lit(jvm_pattern(r"def test_\w+")))
    counted = files.filter(name_matches(F.col("path"), "test_*.py")).select("repo", folder.alias("category"), F.col("path").alias("file"), n.alias("n"))
    sets = [["repo", "category", "file"], ["repo", "category"], ["repo"]]
    totals = counted.filter(F.col("category").isNotNull()).groupingSets([[F.col(c) for c in g] for g in sets], "repo", "category", "file").agg(
        F.sum("n").cast("long").alias("n_tests"), F.grouping_id().cast("int").alias("level"))
    return totals.filter((F.col("level") != 1) | (F.col("n_tests") > 0))
