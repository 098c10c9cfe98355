import re
import textwrap

import pytest
from pyspark.sql import functions as F

from transmuta.functions.facts import code_facts, file_facts, imports
from transmuta.operators import detect, diff, mapping, resolve, rewrite
from transmuta.operators.decisions import decision_gate
from transmuta.sources.catalog import REPO_VALUES, Rule, RuleSet, repositories, rule_set

RULES = rule_set()


def ids(df):
    return [r["id"] for r in df.orderBy("path", "det_seq").collect()]


def test_catalogue():
    assert len(RULES) == 36 and len(rule_set(False)) == 35
    kinds = {}
    for r in rule_set(False):
        kinds[r.type] = kinds.get(r.type, 0) + 1
    assert kinds == {"import": 13, "instantiation": 9, "class_inheritance": 5, "decorator": 3, "method_call": 3, "parameter": 2}
    assert sum(r.confidence == "medium" for r in rule_set(False)) == 5
    assert RULES.rules[-1].id == "SK_IMPORT_" and RULES.rules[-1].pattern == "semantic_kernel"
    assert len(REPO_VALUES) == 21


def test_repositories_by_priority(spark):
    assert repositories(spark).count() == 21
    assert {r["priority"] for r in repositories(spark, "second_pass").collect()} == {"second_pass"}


def test_facts_of_one_file():
    f = file_facts(textwrap.dedent("""
        import os, sys as s
        from .x import y
        from a.b import c
        class A(B, m.C):
            async def g(self):
                def inner():
                    pass
            def f(self):
                assert 1
        def f():
            x = 1
            return x
    """))
    assert [i["name"] for i in f["imports"]] == ["os", "sys"]
    assert [(i["module"], i["level"]) for i in f["from_imports"]] == [("x", 1), ("a.b", 0)]
    assert [(c["name"], c["bases"]) for c in f["classes"]] == [("A", ["B"])]
    assert f["asserts"] == 1 and f["max_nesting"] == 2 and f["max_func_lines"] == 2
    assert file_facts("def broken(\n    return")["err_type"] == "SyntaxError"
    assert file_facts("x = '\0'")["parse_ok"] is False
    assert file_facts(None) is None


def test_imports_table(spark, make_files):
    rows = imports(code_facts(make_files({"a.py": "import os, re\nfrom x.y import z\nfrom . import q\n"}))).orderBy("seq", "module").collect()
    assert [(r["kind"], r["module"]) for r in rows] == [("import", "os"), ("import", "re"), ("from", "x.y")]


@pytest.mark.parametrize("source,expected", [
    ("from semantic_kernel import Kernel", ["IMPORT_SEMANTIC_KERNEL"]),
    ("import semantic_kernel as sk\nfrom autogen import ConversableAgent as C", ["IMPORT_AUTOGEN"]),
    ("# from semantic_kernel import Kernel\n", []),
    ("x = 'from semantic_kernel import Kernel'", []),
    ("from \\\n  semantic_kernel.agents import A", ["IMPORT_SEMANTIC_KERNEL_AGENTS"]),
    ("from .autogen import A", ["IMPORT_AUTOGEN"]),
    ("from sklearn import svm", ["IMPORT_SKLEARN"]),
    ("from ｓｋ import x", ["IMPORT_SK"]),
    ("class A(KernelAgent, GroupChat, x.Kernel): pass", ["CLASS_KernelAgent", "CLASS_GroupChat"]),
    ("def broken(\n    return\nfrom autogen import x", []),
    ("def f():\n    from autogen import x\nfrom semantic_kernel import y", ["IMPORT_SEMANTIC_KERNEL", "IMPORT_AUTOGEN"]),
])
def test_detection_cases(spark, make_files, source, expected):
    assert ids(detect.discover(make_files({"m.py": source}))) == expected


def test_only_python_files_are_detected(spark, make_files):
    assert detect.discover(make_files({"m.txt": "from autogen import x", "m.pyi": "from autogen import x"})).count() == 0


SNIPPETS = {
    "SK_IMPORT_KERNEL": "from semantic_kernel import Kernel", "SK_IMPORT_KERNEL_AS": "from semantic_kernel import Kernel as K",
    "SK_IMPORT_AGENT": "from semantic_kernel.agents import KernelAgent", "SK_IMPORT_CHAT_COMPLETION": "from semantic_kernel.agents import ChatCompletionAgent",
    "SK_IMPORT_PLUGINS": "from semantic_kernel.plugins import P", "SK_IMPORT_FUNCTIONS": "from semantic_kernel.functions import f",
    "SK_IMPORT_KERNEL_BUILDER": "from semantic_kernel import KernelBuilder", "AUTOGEN_IMPORT_CONVERSABLE": "from autogen import ConversableAgent",
    "AUTOGEN_IMPORT_ASSISTANT": "from autogen import AssistantAgent", "AUTOGEN_IMPORT_USER_PROXY": "from autogen import UserProxyAgent",
    "AUTOGEN_IMPORT_GROUPCHAT": "from autogen import GroupChat", "AUTOGEN_IMPORT_MANAGER": "from autogen import GroupChatManager",
    "AUTOGEN_IMPORT_AGENTCHAT": "from autogen.agentchat import x", "SK_KERNEL_INSTANTIATION": "k = Kernel()",
    "SK_KERNEL_BUILDER_INSTANTIATION": "k = KernelBuilder()", "SK_AGENT_INSTANTIATION": "a = KernelAgent()",
    "SK_CHAT_COMPLETION_INSTANTIATION": "a = ChatCompletionAgent()", "AUTOGEN_CONVERSABLE_INSTANTIATION": "a = ConversableAgent()",
    "AUTOGEN_ASSISTANT_INSTANTIATION": "a = AssistantAgent()", "AUTOGEN_USER_PROXY_INSTANTIATION": "a = UserProxyAgent()",
    "AUTOGEN_GROUPCHAT_INSTANTIATION": "g = GroupChat()", "AUTOGEN_MANAGER_INSTANTIATION": "g = GroupChatManager()",
    "SK_CLASS_INHERITANCE_KERNEL_AGENT": "class A(KernelAgent): pass", "SK_CLASS_INHERITANCE_CHAT_COMPLETION": "class Été(ChatCompletionAgent): pass",
    "AUTOGEN_CLASS_INHERITANCE_CONVERSABLE": "class A(ConversableAgent): pass", "AUTOGEN_CLASS_INHERITANCE_ASSISTANT": "class A(AssistantAgent): pass",
    "AUTOGEN_CLASS_INHERITANCE_USER_PROXY": "class A(UserProxyAgent): pass", "SK_DECORATOR_KERNEL_FUNCTION": "@kernel_function\ndef f(): pass",
    "SK_DECORATOR_SEMANTIC_FUNCTION": "@semantic_function\ndef f(): pass", "AUTOGEN_DECORATOR_TOOL": "@autogen.tool\ndef f(): pass",
    "SK_METHOD_KERNEL_ADD_PLUGIN": "k.add_plugin(p)", "SK_METHOD_KERNEL_ADD_FUNCTION": "k.add_function(f)",
    "AUTOGEN_METHOD_INITIATE_CHAT": "a.initiate_chat(b)", "SK_PARAM_KERNEL_TO_CLIENT": "f(kernel=k)", "SK_PARAM_KERNEL_VAR_TO_CLIENT": "def f(kernel: K): pass",
}


def brute_force(content, rules):
    """The ordered fold with the standard library's regexes."""
    applied = []
    for r in rules:
        repl = r.replacement
        if r.type == "class_inheritance" and "{name}" in repl:
            m = re.search(r"class (\w+)\(", content)
            repl = repl.replace("{name}", m.group(1)) if m else repl
        if re.search(r.pattern, content):
            content = re.sub(r.pattern, repl, content)
            applied.append(r.id)
    return content, applied


def test_every_rule_and_their_combinations_against_brute_force(spark, make_files):
    """Each snippet alone, each pair with its neighbour, and all of them in one file."""
    assert set(SNIPPETS) == {r.id for r in rule_set(False)}
    items = list(SNIPPETS.values())
    tree = {f"s{i}.py": s for i, s in enumerate(items)}
    tree |= {f"p{i}.py": a + "\n" + b for i, (a, b) in enumerate(zip(items, items[1:]))}
    tree["all.py"] = "\n".join(items)
    rules = rule_set(False)
    plain = make_files(tree).withColumn("detections", F.array().cast("array<struct<det_seq:int,id:string,type:string,module:string,class:string,confidence:string,source:string,line:int>>"))
    done = rewrite.rewrite(detect.with_rule_detections(plain, rules), rules, mode="review")
    for r in done.collect():
        matching = [x for x in rules if re.search(x.pattern, r["content"])]
        assert [d["id"] for d in r["detections"]] == [x.id for x in matching]
        assert (r["new_content"], r["applied"]) == brute_force(r["content"], matching), r["path"]


def test_resolution_routes(spark, make_files):
    cases = {
        "semantic_kernel": "SK_IMPORT_KERNEL", "semantic_kernel.connectors.ai": "SK_IMPORT_KERNEL", "semantic_kernel.agents": "SK_IMPORT_CHAT_COMPLETION",
        "semantic_kernel.agents.KernelAgent": "SK_IMPORT_AGENT", "semantic_kernel.functions": "SK_IMPORT_FUNCTIONS", "semantic_kernel.plugins.x": "SK_IMPORT_PLUGINS",
        "autogen": "AUTOGEN_IMPORT_CONVERSABLE", "autogen.AssistantAgent": "AUTOGEN_IMPORT_ASSISTANT", "autogen.agentchat": "AUTOGEN_IMPORT_CONVERSABLE", "sklearn": None,
    }
    tree = {f"{i}.py": f"from {m} import x" for i, m in enumerate(cases)}
    files = make_files(tree)
    rows = resolve.explode_resolved(resolve.with_resolved(detect.with_detections(files), RULES)).collect()
    assert {r["module"]: r["rule_id"] for r in rows} == cases
    same = resolve.resolve_rule(detect.discover(files), files, RULES).collect()
    assert {(r["module"], r["rule_id"], r["method"]) for r in same} == {(r["module"], r["rule_id"], r["method"]) for r in rows}


def test_class_names_first_or_each(spark, make_files):
    found = detect.with_detections(make_files({"m.py": "class A(KernelAgent):\n  pass\nclass B(KernelAgent):\n  pass\n"}))
    first = rewrite.rewrite(found, RULES).first()["new_content"]
    each = rewrite.rewrite(found, RULES, per_match=True).first()["new_content"]
    assert first.count("class A(Agent)") == 2
    assert "class A(Agent)" in each and "class B(Agent)" in each


def test_whole_word_option(spark, make_files):
    found = detect.with_detections(make_files({"m.py": "from semantic_kernel import KernelBuilder"}))
    assert "AgentFrameworkClientBuilder" in rewrite.rewrite(found, RULES).first()["new_content"]
    assert rewrite.rewrite(found, RULES.whole_word()).first()["changed"] is False


def test_rewrite_is_idempotent_and_auto_needs_high_confidence(spark, make_files):
    files = make_files({"a.py": "from semantic_kernel import Kernel\nk = Kernel()\n", "b.py": "x = 1\n", "c.py": None})
    once_ = rewrite.migrate(files, RULES)
    again = rewrite.migrate(once_.select("repo", "path", F.col("new_content").alias("content")), RULES)
    assert once_.filter("changed").count() == 1 and again.filter("changed").count() == 0
    medium = RuleSet().plus([{"id": "M", "pattern": "x", "replacement": "y", "confidence": "medium", "type": "import"}])
    dets = files.withColumn("detections", F.expr("array(named_struct('det_seq',0,'id','M','type','import','module',cast(null as string),'class',cast(null as string),'confidence','high','source','rule','line',1))"))
    assert rewrite.rewrite(dets, medium).filter("changed").count() == 0
    assert rewrite.rewrite(dets, medium, "review").filter("changed").count() == 1
    with pytest.raises(ValueError):
        rewrite.rewrite(dets, medium, "other")


def test_output_directory_keeps_originals(spark, make_files):
    done = rewrite.changed_files(rewrite.migrate(make_files({"src/a.py": "from autogen import ConversableAgent"}), RULES), "/out").first()
    assert done["target_path"] == "/out/p/src/a.py" and done["content"].startswith("from autogen")


def test_failure_policies(spark, make_files):
    files = make_files({"a.py": "x", "b.py": None})
    good, failed = rewrite.split_failures(files)
    assert (good.count(), [r["path"] for r in failed.collect()]) == (1, ["p/b.py"])
    with pytest.raises(Exception, match="p/b.py"):
        rewrite.split_failures(files, "stop")[0].select("content").collect()


def test_user_rules_replace_and_extend():
    more = RULES.plus([{"id": "SK_IMPORT_KERNEL", "pattern": "p", "replacement": "q"}, {"id": "MINE", "pattern": "a", "replacement": "b"}])
    assert len(more) == 37 and more.get("SK_IMPORT_KERNEL").rule_ord == 0 and more.get("MINE").rule_ord == 36


def test_rule_table_limit(spark, monkeypatch):
    table = RULES.table(spark)
    assert [r.id for r in RuleSet.from_table(table)] == [r.id for r in RULES]
    monkeypatch.setattr(RuleSet, "LIMIT", 10)
    with pytest.raises(ValueError):
        RuleSet.from_table(table)


def test_rule_table_through_its_index_equals_the_array(spark, make_files, monkeypatch):
    files = make_files({**{f"{i}.py": s for i, s in enumerate(SNIPPETS.values())}, "none.py": None, "empty.py": "", "short.py": "ab", "é.py": "größe = 1 # ÄÖ"})
    more = RULES.plus([{"id": i, "pattern": p, "replacement": ""} for i, p in (("ANY", r"\w+_\w+"), ("SHORT", "ab"), ("UMLAUT", r"größe\s"), ("CASE", "(?i)KERNEL"))])
    monkeypatch.setattr(RuleSet, "LIMIT", 20)
    parts = detect.scan_rule_table(files, more.table(spark))
    want = sorted(map(tuple, detect.regex_rule_scan(files, more).select(parts.columns).collect()))
    assert sorted(map(tuple, parts.collect())) == want and {"ANY", "SHORT", "UMLAUT", "CASE"} <= {r[3] for r in want}
    assert detect.scan_rule_table(files.limit(0), more.table(spark)).count() == 0 and detect.scan_rule_table(files, more.table(spark).limit(0)).count() == 0


def test_twenty_thousand_rules_in_one_scan(spark, make_files):
    files = make_files({f"f{i}.py": f"call_{37 * i}(x)\nprefix common_{i} end\n" for i in range(200)})
    rules = spark.range(20_000).select(
        F.col("id").cast("int").alias("rule_ord"), F.concat(F.lit("R"), "id").alias("id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("call_"), "id", F.lit(r"\("))).otherwise(
            F.concat(F.lit(r"prefix\s+common_"), "id", F.lit(r"\b"))).alias("pattern"), F.lit("x").alias("type"), F.lit("f").alias("framework"), F.lit("high").alias("confidence"), F.lit("rule").alias("source"))
    found = detect.scan_rule_table(files, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    want = {(f"p/f{i}.py", f"R{37 * i}") for i in range(0, 200, 2)} | {(f"p/f{i}.py", f"R{i}") for i in range(1, 200, 2)}
    assert {(r["path"], r["id"]) for r in found.collect()} == want and found.count() == len(want)
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan


def test_detections_of_missing_files_stay(spark, make_files):
    files = make_files({"a.py": "class A(KernelAgent): pass\nfrom autogen import x"})
    rows = resolve.resolve_rule(detect.discover(files), files.limit(0), RULES).collect()
    assert {(r["id"], r["rule_id"]) for r in rows} == {("CLASS_KernelAgent", None), ("IMPORT_AUTOGEN", "AUTOGEN_IMPORT_CONVERSABLE")}


def test_changed_files_can_be_written(spark, make_files, tmp_path):
    rewrite.write_changed(rewrite.migrate(make_files({"a.py": "from autogen import ConversableAgent", "b.py": "x"}), RULES), str(tmp_path / "o"), "/out")
    assert [(r["repo"], r["target_path"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("p", "/out/p/a.py")]


def test_decision_gate_order(spark):
    changes = spark.createDataFrame([("p", f"f{i}", "R") for i in range(5)], "repo string, path string, rule_id string")
    by_rule = spark.createDataFrame([("p", "f0", "R", "s"), ("p", "f1", "R", "a")], "repo string, path string, rule_id string, decision string")
    by_file = spark.createDataFrame([("p", "f0", "y"), ("p", "f2", "y"), ("p", "f3", "e")], "repo string, path string, decision string")
    kept = {r["path"]: r["kept"] for r in decision_gate(changes, by_rule, by_file).collect()}
    assert kept == {"f0": False, "f1": True, "f2": True, "f3": False, "f4": False}
    assert decision_gate(changes, mode="auto").filter("kept").count() == 5


def test_diff_matches_zip_and_flags_surplus(spark, make_files):
    before, after = make_files({"a.py": "1\n2\n3\n", "b.py": "x"}), make_files({"a.py": "1\nB\n3\n4\n", "b.py": "x", "c.py": "n"})
    rows = diff.line_diff(before, after).orderBy("line_no").collect()
    assert [(r["line_no"], r["kind"], r["hunk"], r["before"], r["after"]) for r in rows] == [
        (2, "modified", "@@ -2,1 +2,1 @@", "2", "B"), (4, "added", None, None, "4")]
    status = {r["path"]: r["status"] for r in diff.snapshot_diff(before, after).collect()}
    assert status == {"p/a.py": "modified", "p/b.py": "same", "p/c.py": "added"}
    assert diff.snapshot_status(diff.snapshot_diff(before, before)).first()["state"] == "clean"


def test_output_statuses(spark, make_files):
    found = detect.with_detections(make_files({"m.py": "from semantic_kernel.plugins import P\nfrom semantic_kernel.agents import x\n"}))
    rows = {r["pattern_id"]: r["status"] for r in mapping.output_mapping(rewrite.rewrite(found, RULES), RULES).collect()}
    assert rows == {"IMPORT_SEMANTIC_KERNEL_PLUGINS": "success", "IMPORT_SEMANTIC_KERNEL_AGENTS": "error"}
    report = mapping.mapping_report(rewrite.rewrite(found, RULES), RULES).first()
    assert report["mapping_complete"] and report["patterns_detected"] == 2


def test_backref_codemod(spark, make_files):
    files = make_files({"t.py": "import shutil\nshutil.rmtree(temp_dir)\nshutil.rmtree(git_repo_1)\n", "u.py": "shutil.rmtree(x)"})
    rows = {r["path"]: r["new_content"] for r in rewrite.backref_codemod(
        files, rewrite.CLEANUP_PATTERN, rewrite.CLEANUP_REPLACEMENT, rewrite.CLEANUP_GATES, rewrite.CLEANUP_ANCHOR, rewrite.CLEANUP_IMPORT).collect()}
    assert rows["p/t.py"] == "import shutil\nfrom tests.utils.cleanup import safe_rmtree\nsafe_rmtree(temp_dir)\nsafe_rmtree(git_repo_1)\n"
    assert rows["p/u.py"] == "shutil.rmtree(x)"
    src = "orchestrator = Orchestrator(context)\n        orchestrator.run_apply_auto()"
    out = rewrite.backref_codemod(make_files({"w.py": src}), rewrite.ANALYSIS_PATTERN, rewrite.ANALYSIS_REPLACEMENT).first()["new_content"]
    assert out == re.sub(rewrite.ANALYSIS_PATTERN, rewrite.ANALYSIS_REPLACEMENT, src)


def test_rewrite_plan_has_no_shuffle_and_parses_once(spark, tmp_path):
    spark.createDataFrame([("p", "p/a.py", "from autogen import x")], "repo string, path string, content string").write.parquet(str(tmp_path / "f"))
    done = rewrite.changed_files(rewrite.migrate(spark.read.parquet(str(tmp_path / "f")), RULES))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_custom_rule_type(spark, make_files):
    rule = Rule(0, "k", "R1", r"print\((\w+)\)", r"log(\1)", "high", "call")
    rows = detect.regex_rule_scan(make_files({"a.py": "print(x)", "b.py": "pass"}), RuleSet((rule,))).collect()
    assert [(r["path"], r["id"]) for r in rows] == [("p/a.py", "R1")]
