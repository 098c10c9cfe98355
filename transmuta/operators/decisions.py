"""Gates that decide which changes are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from transmuta.functions.joins import salted_join

# fixed values: answers that keep a change; every other answer drops it
KEEP = ("a", "y", "o")
# fixed values: what a stored rule decision means for a change
STORED = {"auto_apply": "a", "manual": "s", "skip": "s"}


def decision_gate(changes: DataFrame, by_rule: DataFrame | None = None, by_file: DataFrame | None = None,
                  stored: DataFrame | None = None, mode: str = "review") -> DataFrame:
    """changes(repo, path, rule_id) + decision, kept.

    The answer for (rule, file) comes first, then the answer for the file, then the stored decision for the rule;
    without any, review skips the change and auto keeps it.
    """
    out = changes
    answers = []
    if by_rule is not None:
        out = out.join(by_rule.select("repo", "path", "rule_id", F.col("decision").alias("_rule")), ["repo", "path", "rule_id"], "left")
        answers.append(F.col("_rule"))
    if by_file is not None:
        out = out.join(by_file.select("repo", "path", F.col("decision").alias("_file")), ["repo", "path"], "left")
        answers.append(F.col("_file"))
    if stored is not None:
        meaning = F.create_map(*[F.lit(x) for kv in STORED.items() for x in kv])
        table = stored.select(F.col("pattern_id").alias("rule_id"), F.try_element_at(meaning, "decision").alias("_stored"))
        out = salted_join(out, table, ["rule_id"], "left", spread_by=["path"])
        answers.append(F.col("_stored"))
    decision = F.coalesce(*answers, F.lit("s" if mode == "review" else "a"))
    return out.select(*changes.columns, decision.alias("decision"), decision.isin(*KEEP).alias("kept"))
