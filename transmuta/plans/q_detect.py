"""Queries over detection, resolution and their joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from transmuta.functions.materialize import cut, shared_folder
from transmuta.operators import decisions, detect, diff, outliers, reports, resolve, resume, rewrite, validate
from transmuta.plans.base import CTES, RULES, corpus, known, query
from transmuta.plans.q_sources import decision_writes
from transmuta.sources import derived, stores

LIMITS = outliers.Limits(max_lines=40, max_func_lines=1, max_nesting=0, max_depth=2, max_files=48, min_files=49, max_size_ratio=5.0)


def report_files(spark, sf):
    """Corpus with the detections of a report that also names rule ids."""
    return detect.with_rule_detections(detect.with_detections(corpus(spark, sf)), RULES)


@query("detect_imports", "SELECT repo, path, id, type, module, line FROM detections WHERE type = 'import'")
def _(spark, sf):
    return detect.detect_imports(corpus(spark, sf)).select("repo", "path", "id", "type", "module", "line")


@query("detect_class_bases", "SELECT repo, path, id, type, class, line FROM detections WHERE type = 'class_inheritance'")
def _(spark, sf):
    return detect.detect_class_bases(corpus(spark, sf)).select("repo", "path", "id", "type", "class", "line")


@query("discover", "SELECT repo, path, det_seq, id, type, module, class, confidence, source, line FROM detections")
def _(spark, sf):
    return detect.discover(corpus(spark, sf))


@query("regex_rule_scan", "SELECT repo, path, CAST(rule_ord AS INTEGER) AS rule_ord, id, type, framework, confidence, source FROM rule_hits")
def _(spark, sf):
    return detect.regex_rule_scan(corpus(spark, sf), RULES)


@query("rule_table_scan", "SELECT repo, path, CAST(rule_ord AS INTEGER) AS rule_ord, id, type, framework, confidence, source FROM rule_hits")
def _(spark, sf):
    """The same hits from the rules as a table, through their index."""
    return detect.scan_rule_table(corpus(spark, sf), RULES.table(spark))


@query("match_counts", r"SELECT repo, path, len(regexp_extract_all(content, 'def test_\w+')) AS n_matches FROM files")
def _(spark, sf):
    return detect.match_counts(corpus(spark, sf), r"def test_\w+")


@query("high_confidence", "SELECT repo, path, id FROM rule_hits WHERE confidence = 'high' AND source = 'rule'")
def _(spark, sf):
    return detect.high_confidence(detect.regex_rule_scan(corpus(spark, sf), RULES)).select("repo", "path", "id")


@query("enrich_guidance", """
SELECT repo, path, det_seq, id, CASE WHEN contains(lower(id), 'semantic_kernel') THEN 'semantic_kernel' ELSE 'autogen' END AS framework,
  CASE WHEN contains(lower(id), 'semantic_kernel') THEN 'https://learn.microsoft.com/en-us/agent-framework/migration-guide/from-semantic-kernel/'
   ELSE 'https://learn.microsoft.com/en-us/agent-framework/migration-guide/from-autogen/' END AS guide_url, CAST(NULL AS VARCHAR) AS guidance FROM detections""")
def _(spark, sf):
    return detect.enrich_guidance(detect.discover(corpus(spark, sf))).select("repo", "path", "det_seq", "id", "framework", "guide_url", "guidance")


@query("analysis_report", """
SELECT s.repo, s.total_files, s.patterns_detected, s.files_with_patterns, o.is_outlier, o.risk_level FROM (
  SELECT f.repo, count(*) AS total_files, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS patterns_detected, count(d.n) AS files_with_patterns
  FROM scanned f LEFT JOIN (SELECT doc_id, count(*) AS n FROM detections GROUP BY doc_id) d ON d.doc_id = f.doc_id GROUP BY f.repo) s
LEFT JOIN outlier_reports o ON o.repo = s.repo""")
def _(spark, sf):
    return reports.judged_statistics(outliers.file_flags(corpus(spark, sf), LIMITS, with_detections=True), LIMITS)


@query("resolve_rule", """
SELECT repo, path, det_seq, id, type, CAST(rule_ord AS INTEGER) AS rule_ord, rule_id, rule_confidence, method FROM resolved_report""")
def _(spark, sf):
    files = corpus(spark, sf)
    # the detection table of a saved report: written once, then resolved
    rows = resolve.resolve_rule(cut(detect.rule_detections(files, RULES)), files, RULES)
    return rows.select("repo", "path", "det_seq", "id", "type", "rule_ord", "rule_id", "rule_confidence", "method")


@query("first_matching_rule", """
SELECT h.repo, h.path, h.type, CAST(min(h.rule_ord) AS INTEGER) AS rule_ord, min_by(h.id, h.rule_ord) AS rule_id FROM rule_hits h GROUP BY h.repo, h.path, h.type""")
def _(spark, sf):
    return resolve.first_matching_rule(corpus(spark, sf), RULES).drop("rule_confidence")


@query("files_for_detections", """
SELECT f.repo, f.path FROM files f WHERE f.doc_id IN (SELECT doc_id FROM detections WHERE starts_with(module, 'semantic_kernel.plugins'))
  OR f.repo NOT IN (SELECT repo FROM detections WHERE starts_with(module, 'semantic_kernel.plugins'))""")
def _(spark, sf):
    return detect.files_for_detections(detect.with_detections(corpus(spark, sf), ("semantic_kernel.plugins",), ()))


CTES["answers_rule"] = """
SELECT repo, path, rule_id, CASE length(path) % 3 WHEN 0 THEN 's' ELSE 'a' END AS decision
FROM (SELECT DISTINCT repo, path, rule_id FROM resolved_report WHERE rule_id IS NOT NULL) WHERE (length(path) + length(rule_id)) % 4 = 0"""
CTES["answers_file"] = """
SELECT repo, path, CASE length(content) % 3 WHEN 0 THEN 'y' WHEN 1 THEN 'n' ELSE 'e' END AS decision FROM files WHERE length(content) % 5 = 0"""


@query("decision_gate", """
SELECT r.repo, r.path, r.det_seq, r.rule_id, coalesce(a.decision, b.decision, CASE WHEN s.decision = 'auto_apply' THEN 'a' WHEN s.decision IS NOT NULL THEN 's' END, 's') AS decision,
  coalesce(a.decision, b.decision, CASE WHEN s.decision = 'auto_apply' THEN 'a' WHEN s.decision IS NOT NULL THEN 's' END, 's') IN ('a', 'y', 'o') AS kept
FROM (SELECT * FROM resolved_report WHERE rule_id IS NOT NULL) r
LEFT JOIN answers_rule a ON a.repo = r.repo AND a.path = r.path AND a.rule_id = r.rule_id
LEFT JOIN answers_file b ON b.repo = r.repo AND b.path = r.path
LEFT JOIN decisions s ON s.pattern_id = r.rule_id""")
def _(spark, sf):
    files = report_files(spark, sf)
    changes = resolve.explode_resolved(resolve.with_resolved(files, RULES)).filter(F.col("rule_id").isNotNull()).select(
        "repo", "path", "det_seq", "rule_id")
    by_rule = changes.select("repo", "path", "rule_id").distinct().filter((F.length("path") + F.length("rule_id")) % 4 == 0).withColumn(
        "decision", F.when(F.length("path") % 3 == 0, "s").otherwise("a"))
    n = F.length("content")
    by_file = corpus(spark, sf).filter(n % 5 == 0).select(
        "repo", "path", F.when(n % 3 == 0, "y").when(n % 3 == 1, "n").otherwise("e").alias("decision"))
    stored = stores.decision_state(decision_writes(spark, sf))
    return decisions.decision_gate(changes, by_rule, by_file, stored, "review")


@query("outlier_gate", """
SELECT r.repo, r.path, CAST(len(r.applied) AS INTEGER) AS n_applied FROM (SELECT repo, path, doc_id, applied FROM rewritten WHERE changed) r
WHERE r.doc_id NOT IN (SELECT doc_id FROM reasons)""")
def _(spark, sf):
    done = rewrite.migrate(corpus(spark, sf), RULES, outlier_mode="cautious", limits=LIMITS)
    return done.filter("changed").select("repo", "path", F.size("applied").alias("n_applied"))


@query("unresolved_imports", "SELECT repo, path, line_no, message FROM issues WHERE error_type = 'ImportWarning'")
def _(spark, sf):
    return validate.unresolved_imports(corpus(spark, sf), known(spark)).select("repo", "path", "line_no", "message")


CTES["files_after"] = """
SELECT doc_id, repo, path, CASE WHEN doc_id % 3 <> 0 THEN replace(content, 'Kernel()', 'Client()') ELSE content END AS content FROM files WHERE doc_id % 17 <> 0
UNION ALL SELECT doc_id, repo, path || 'x', content FROM files WHERE doc_id % 17 = 1"""


def snapshots(spark, sf):
    before = derived.derived_corpus(spark, sf, with_id=True)
    edited = F.when(F.col("doc_id") % 3 != 0, F.replace("content", F.lit("Kernel()"), F.lit("Client()"))).otherwise(F.col("content"))
    after = before.filter(F.col("doc_id") % 17 != 0).withColumn("content", edited).unionByName(
        before.filter(F.col("doc_id") % 17 == 1).withColumn("path", F.concat("path", F.lit("x"))))
    return before.drop("doc_id"), after.drop("doc_id")


@query("line_diff", """
WITH b AS (SELECT doc_id, repo, path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no, unnest(string_split(content, chr(10))) AS line FROM files),
a AS (SELECT path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no, unnest(string_split(content, chr(10))) AS line FROM files_after)
SELECT b.repo, b.path, CAST(b.line_no AS INTEGER) AS line_no, '@@ -' || b.line_no || ',1 +' || b.line_no || ',1 @@' AS hunk, 'modified' AS kind, b.line AS before, a.line AS after
FROM b JOIN a ON a.path = b.path AND a.line_no = b.line_no WHERE a.line <> b.line""")
def _(spark, sf):
    return diff.line_diff(*snapshots(spark, sf))


@query("turn_diff", """
WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS arr FROM conversations),
p AS (SELECT b.conv_id, b.turn, b.arr AS old, a.arr AS new FROM l b JOIN l a ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
n AS (SELECT conv_id, turn, old, new, unnest(generate_series(1, greatest(len(old), len(new)))) AS line_no FROM p)
SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, CASE WHEN line_no > len(new) THEN 'removed' WHEN line_no > len(old) THEN 'added' ELSE 'modified' END AS kind,
  old[line_no] AS before, new[line_no] AS after FROM n WHERE old[line_no] IS DISTINCT FROM new[line_no]""")
def _(spark, sf):
    turns = derived.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = turns.withColumn("turn", F.col("turn") - 1)
    return diff.line_diff(turns, nxt, ("conv_id", "turn"), "text").drop("hunk")


CTES["snapshot_rows"] = """
SELECT coalesce(b.repo, a.repo) AS repo, coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
  WHEN a.content = b.content THEN 'same' ELSE 'modified' END AS status FROM files b FULL JOIN files_after a ON a.repo = b.repo AND a.path = b.path"""


@query("snapshot_diff", "SELECT repo, path, status FROM snapshot_rows")
def _(spark, sf):
    return diff.snapshot_diff(*snapshots(spark, sf))


@query("snapshot_status", """
SELECT repo, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'modified') AS modified,
  count(*) FILTER (status = 'same') AS same, count(*) FILTER (status <> 'same') > 0 AS has_changes, CASE WHEN count(*) FILTER (status <> 'same') > 0 THEN 'dirty' ELSE 'clean' END AS state
FROM snapshot_rows GROUP BY repo""")
def _(spark, sf):
    return diff.snapshot_status(diff.snapshot_diff(*snapshots(spark, sf)))


@query("suffix_match", """
SELECT DISTINCT f.repo, f.path, m.rel FROM files f JOIN (SELECT repo, substring(path, length(repo) + 2) AS rel FROM mixed WHERE is_mixed AND NOT contains(path, '/venv/')) m
  ON m.repo = f.repo AND ends_with(f.path, m.rel)""")
def _(spark, sf):
    files = corpus(spark, sf)
    flags = outliers.file_flags(files, outliers.Limits())
    listed = flags.filter("mixed_indentation").select("repo", "rel")
    return outliers.suffix_match(files.select("repo", "path"), listed)


# ---- rewrite ---------------------------------------------------------------------------------------------------

@query("rewrite", "SELECT repo, path, md5(new_content) AS digest, CAST(len(applied) AS INTEGER) AS n_applied, changed FROM rewritten_report")
def _(spark, sf):
    return rewrite.rewrite(report_files(spark, sf), RULES).select(
        "repo", "path", F.md5("new_content").alias("digest"), F.size("applied").alias("n_applied"), "changed")


CTES["per_match"] = r"""
SELECT doc_id, repo, path, content, CASE WHEN doc_id IN (SELECT doc_id FROM detections WHERE id = 'CLASS_KernelAgent')
  THEN regexp_replace(content, 'class (\w+)\(KernelAgent\)', 'class \1(Agent)', 'g') ELSE content END AS new_content FROM files"""


@query("rewrite_class_names", r"""
SELECT repo, path, 'first_class' AS binding, md5(new_content) AS digest FROM rewritten WHERE list_contains(applied, 'SK_CLASS_INHERITANCE_KERNEL_AGENT')
UNION ALL SELECT repo, path, 'each_class', md5(new_content) FROM per_match WHERE content <> new_content""")
def _(spark, sf):
    found = detect.with_detections(corpus(spark, sf))
    outs = []
    for per_match, name in ((False, "first_class"), (True, "each_class")):
        done = rewrite.rewrite(found, RULES, per_match=per_match).filter(F.array_contains("applied", "SK_CLASS_INHERITANCE_KERNEL_AGENT"))
        outs.append(done.select("repo", "path", F.lit(name).alias("binding"), F.md5("new_content").alias("digest")))
    return outs[0].unionByName(outs[1])


@query("applied_rules", """
SELECT repo, path, CAST(unnest(generate_series(1, len(applied))) - 1 AS INTEGER) AS apply_seq, unnest(applied) AS rule_id FROM rewritten_report""")
def _(spark, sf):
    return rewrite.applied_rules(rewrite.rewrite(report_files(spark, sf), RULES))


@query("confidence_gate", """
SELECT repo, path, det_seq, id, rule_id FROM resolved_report WHERE confidence = 'high' AND source = 'rule' AND rule_confidence = 'high'""")
def _(spark, sf):
    rows = resolve.explode_resolved(resolve.with_resolved(report_files(spark, sf), RULES))
    return rewrite.confidence_gate(rows).select("repo", "path", "det_seq", "id", "rule_id")


@query("changed_files", """
SELECT repo, path, '/out/' || repo || '/' || substring(path, length(repo) + 2) AS target_path, md5(new_content) AS digest FROM rewritten WHERE changed""")
def _(spark, sf):
    done = rewrite.changed_files(rewrite.migrate(corpus(spark, sf), RULES), "/out")
    return done.select("repo", "path", "target_path", F.md5("new_content").alias("digest"))


CTES["cleanup_files"] = r"""
SELECT repo, path, CASE WHEN doc_id % 2 = 0 THEN 'import os' || chr(10) || 'import shutil' || chr(10) ELSE '' END || content || chr(10)
  || CASE doc_id % 3 WHEN 0 THEN 'shutil.rmtree(temp_dir)' WHEN 1 THEN 'shutil.rmtree(git_repo_2)' ELSE 'shutil.rmtree(repo); shutil.rmtree(other)' END AS content
FROM files WHERE contains(path, '/tests/')"""


@query("backref_codemod", r"""
SELECT repo, path, md5(new_content) AS digest, new_content <> content AS changed FROM (SELECT repo, path, content,
  CASE WHEN contains(content, 'shutil.rmtree(temp_dir)') OR contains(content, 'shutil.rmtree(repo)') THEN regexp_replace(
    CASE WHEN contains(content, 'import shutil') THEN left(content, instr(content, 'import shutil') + 12) || chr(10) || 'from tests.utils.cleanup import safe_rmtree'
      || substring(content, instr(content, 'import shutil') + 13) ELSE content END,
    'shutil\.rmtree\((temp_dir|repo|fixture|git_repo[_\w]*)\)', 'safe_rmtree(\1)', 'g') ELSE content END AS new_content FROM cleanup_files)""")
def _(spark, sf):
    files = derived.derived_corpus(spark, sf, with_id=True).filter(F.col("path").contains("/tests/"))
    head = F.when(F.col("doc_id") % 2 == 0, F.lit("import os\nimport shutil\n")).otherwise("")
    tail = F.when(F.col("doc_id") % 3 == 0, "shutil.rmtree(temp_dir)").when(F.col("doc_id") % 3 == 1, "shutil.rmtree(git_repo_2)").otherwise(
        "shutil.rmtree(repo); shutil.rmtree(other)")
    files = files.withColumn("content", F.concat(head, "content", F.lit("\n"), tail)).drop("doc_id")
    done = rewrite.backref_codemod(files, rewrite.CLEANUP_PATTERN, rewrite.CLEANUP_REPLACEMENT, rewrite.CLEANUP_GATES,
                                   rewrite.CLEANUP_ANCHOR, rewrite.CLEANUP_IMPORT, targets=files.select("repo", "path"))
    return done.select("repo", "path", F.md5("new_content").alias("digest"), "changed")


@query("migrate", """
SELECT repo, path, array_to_string(applied, ',') AS applied_ids, md5(new_content) AS digest, length(new_content) AS n_chars FROM rewritten WHERE changed""")
def migrate(spark, sf):
    done = rewrite.changed_files(rewrite.migrate(corpus(spark, sf), RULES))
    return done.select("repo", "path", F.array_join("applied", ",").alias("applied_ids"), F.md5("new_content").alias("digest"),
                       F.length("new_content").cast("long").alias("n_chars"))


@query("migrate_resumed", """
SELECT repo, path, array_to_string(applied, ',') AS applied_ids, md5(new_content) AS digest, length(new_content) AS n_chars FROM rewritten WHERE changed""")
def _(spark, sf):
    """A run that is stopped after one of four waves, and the run that goes on from there."""
    out = f"{shared_folder(spark)}/resumed-{uuid.uuid4().hex}"
    files = corpus(spark, sf)
    resume.migrate(files, RULES, out, waves=4, stop_after=1)
    resume.migrate(files, RULES, out, waves=4)
    return resume.migrated(spark, out).select("repo", "path", F.array_join("applied", ",").alias("applied_ids"), F.md5("content").alias("digest"),
                                              F.length("content").cast("long").alias("n_chars"))
