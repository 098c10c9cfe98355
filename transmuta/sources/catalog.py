"""Static catalogues: rewrite rules, guides, mappings, best practices, links, validation repositories.

The texts below are fixed values that results depend on; everything else is ordinary code.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from transmuta import schemas
from transmuta.functions.constants import constant_table
from transmuta.functions.pyre import jvm_pattern, jvm_replacement, required_literal

# --- fixed values: guides by framework (framework, url, samples_url, title) ---------------------------------
GUIDES = [
    ("semantic_kernel",
     "https://learn.microsoft.com/en-us/agent-framework/migration-guide/from-semantic-kernel/",
     "https://learn.microsoft.com/en-us/agent-framework/migration-guide/from-semantic-kernel/samples",
     "Semantic Kernel to Microsoft Agent Framework Migration Guide"),
    ("autogen",
     "https://learn.microsoft.com/en-us/agent-framework/migration-guide/from-autogen/",
     None,
     "AutoGen to Microsoft Agent Framework Migration Guide"),
]

# --- fixed values: concept mappings (framework, mapping, from, to, notes) -----------------------------------
MAPPINGS = [
    ("semantic_kernel", "imports", "semantic_kernel", "microsoft.agentframework",
     "Package imports change from semantic_kernel to microsoft.agentframework"),
    ("semantic_kernel", "agent_types", "KernelAgent, ChatCompletionAgent", "Agent (unified type)",
     "Agent types consolidated into unified Agent class"),
    ("semantic_kernel", "dependency_injection", "IKernel, KernelBuilder",
     "AgentFrameworkClient, dependency injection patterns", "Client initialization and DI patterns updated"),
    ("autogen", "agent_types", "ConversableAgent, AssistantAgent, UserProxyAgent", "Agent (unified type)",
     "AutoGen agent types unified into MAF Agent class"),
    ("autogen", "multi_agent", "GroupChat, GroupChatManager", "Agent orchestration patterns",
     "Multi-agent patterns updated to MAF orchestration"),
    ("autogen", "tools", "@tool decorator, function calling", "MAF tool integration patterns",
     "Tool integration patterns updated"),
]

# --- fixed values: best practices in order ------------------------------------------------------------------
BEST_PRACTICES = [
    "Start with package import changes",
    "Update agent type declarations",
    "Review dependency injection patterns",
    "Test individual components before full migration",
    "Use official migration samples as reference",
    "Verify resource management patterns",
    "Check client initialization changes",
]

# --- fixed values: reference links ---------------------------------------------------------------------------
REFERENCE_URLS = [
    ("sk_migration_guide", "https://learn.microsoft.com/en-us/agent-framework/migration-guide/from-semantic-kernel/"),
    ("sk_samples", "https://learn.microsoft.com/en-us/agent-framework/migration-guide/from-semantic-kernel/samples"),
    ("autogen_migration_guide", "https://learn.microsoft.com/en-us/agent-framework/migration-guide/from-autogen/"),
    ("maf_overview", "https://learn.microsoft.com/en-us/agent-framework/overview/agent-framework-overview"),
    ("maf_docs", "https://learn.microsoft.com/en-us/agent-framework/"),
]

# --- fixed values: rewrite rules in order (key, pattern, replacement, confidence, type, framework, description)
RULE_VALUES = [
    ("sk_import_kernel", r"from semantic_kernel import Kernel",
     "from microsoft.agentframework import AgentFrameworkClient",
     "high", "import", "semantic_kernel", "Replace Kernel import with AgentFrameworkClient"),
    ("sk_import_kernel_as", r"from semantic_kernel import Kernel as \w+",
     "from microsoft.agentframework import AgentFrameworkClient",
     "high", "import", "semantic_kernel", "Replace Kernel import (with alias) with AgentFrameworkClient"),
    ("sk_import_agent", r"from semantic_kernel\.agents import KernelAgent",
     "from microsoft.agentframework.agents import Agent",
     "high", "import", "semantic_kernel", "Replace KernelAgent import with Agent"),
    ("sk_import_chat_completion", r"from semantic_kernel\.agents import ChatCompletionAgent",
     "from microsoft.agentframework.agents import Agent",
     "high", "import", "semantic_kernel", "Replace ChatCompletionAgent import with Agent"),
    ("sk_import_plugins", r"from semantic_kernel\.plugins import",
     "from microsoft.agentframework.tools import",
     "high", "import", "semantic_kernel", "Replace plugins imports with tools imports"),
    ("sk_import_functions", r"from semantic_kernel\.functions import",
     "from microsoft.agentframework.tools import",
     "high", "import", "semantic_kernel", "Replace functions imports with tools imports"),
    ("sk_import_kernel_builder", r"from semantic_kernel import KernelBuilder",
     "from microsoft.agentframework import AgentFrameworkClientBuilder",
     "medium", "import", "semantic_kernel", "Replace KernelBuilder import with AgentFrameworkClientBuilder"),
    ("autogen_import_conversable", r"from autogen import ConversableAgent",
     "from microsoft.agentframework.agents import Agent",
     "high", "import", "autogen", "Replace ConversableAgent import with Agent"),
    ("autogen_import_assistant", r"from autogen import AssistantAgent",
     "from microsoft.agentframework.agents import Agent",
     "high", "import", "autogen", "Replace AssistantAgent import with Agent"),
    ("autogen_import_user_proxy", r"from autogen import UserProxyAgent",
     "from microsoft.agentframework.agents import Agent",
     "high", "import", "autogen", "Replace UserProxyAgent import with Agent"),
    ("autogen_import_groupchat", r"from autogen import GroupChat",
     "from microsoft.agentframework.orchestration import WorkflowGraph",
     "high", "import", "autogen", "Replace GroupChat import with WorkflowGraph"),
    ("autogen_import_manager", r"from autogen import GroupChatManager",
     "from microsoft.agentframework.orchestration import WorkflowOrchestrator",
     "high", "import", "autogen", "Replace GroupChatManager import with WorkflowOrchestrator"),
    ("autogen_import_agentchat", r"from autogen\.agentchat import",
     "from microsoft.agentframework.orchestration import",
     "high", "import", "autogen", "Replace agentchat imports with orchestration imports"),
    ("sk_kernel_instantiation", r"Kernel\(", "AgentFrameworkClient(",
     "high", "instantiation", "semantic_kernel", "Replace Kernel() instantiation with AgentFrameworkClient()"),
    ("sk_kernel_builder_instantiation", r"KernelBuilder\(", "AgentFrameworkClientBuilder(",
     "medium", "instantiation", "semantic_kernel",
     "Replace KernelBuilder() instantiation with AgentFrameworkClientBuilder()"),
    ("sk_agent_instantiation", r"KernelAgent\(", "Agent(",
     "high", "instantiation", "semantic_kernel", "Replace KernelAgent() instantiation with Agent()"),
    ("sk_chat_completion_instantiation", r"ChatCompletionAgent\(", "Agent(",
     "high", "instantiation", "semantic_kernel", "Replace ChatCompletionAgent() instantiation with Agent()"),
    ("autogen_conversable_instantiation", r"ConversableAgent\(", "Agent(",
     "high", "instantiation", "autogen", "Replace ConversableAgent() instantiation with Agent()"),
    ("autogen_assistant_instantiation", r"AssistantAgent\(", "Agent(",
     "high", "instantiation", "autogen", "Replace AssistantAgent() instantiation with Agent()"),
    ("autogen_user_proxy_instantiation", r"UserProxyAgent\(", "Agent(",
     "high", "instantiation", "autogen", "Replace UserProxyAgent() instantiation with Agent()"),
    ("autogen_groupchat_instantiation", r"GroupChat\(", "WorkflowGraph(",
     "high", "instantiation", "autogen", "Replace GroupChat() instantiation with WorkflowGraph()"),
    ("autogen_manager_instantiation", r"GroupChatManager\(", "WorkflowOrchestrator(",
     "high", "instantiation", "autogen", "Replace GroupChatManager() instantiation with WorkflowOrchestrator()"),
    ("sk_class_inheritance_kernel_agent", r"class \w+\(KernelAgent\)", "class {name}(Agent)",
     "high", "class_inheritance", "semantic_kernel", "Replace KernelAgent base class with Agent"),
    ("sk_class_inheritance_chat_completion", r"class \w+\(ChatCompletionAgent\)", "class {name}(Agent)",
     "high", "class_inheritance", "semantic_kernel", "Replace ChatCompletionAgent base class with Agent"),
    ("autogen_class_inheritance_conversable", r"class \w+\(ConversableAgent\)", "class {name}(Agent)",
     "high", "class_inheritance", "autogen", "Replace ConversableAgent base class with Agent"),
    ("autogen_class_inheritance_assistant", r"class \w+\(AssistantAgent\)", "class {name}(Agent)",
     "high", "class_inheritance", "autogen", "Replace AssistantAgent base class with Agent"),
    ("autogen_class_inheritance_user_proxy", r"class \w+\(UserProxyAgent\)", "class {name}(Agent)",
     "high", "class_inheritance", "autogen", "Replace UserProxyAgent base class with Agent"),
    ("sk_decorator_kernel_function", r"@kernel_function", "@tool",
     "high", "decorator", "semantic_kernel", "Replace @kernel_function decorator with @tool"),
    ("sk_decorator_semantic_function", r"@semantic_function", "@tool",
     "high", "decorator", "semantic_kernel", "Replace @semantic_function decorator with @tool"),
    ("autogen_decorator_tool", r"@autogen\.tool", "@tool",
     "high", "decorator", "autogen", "Replace @autogen.tool decorator with @tool"),
    ("sk_method_kernel_add_plugin", r"\.add_plugin\(", ".add_tool(",
     "medium", "method_call", "semantic_kernel", "Replace add_plugin() method with add_tool()"),
    ("sk_method_kernel_add_function", r"\.add_function\(", ".add_tool(",
     "medium", "method_call", "semantic_kernel", "Replace add_function() method with add_tool()"),
    ("autogen_method_initiate_chat", r"\.initiate_chat\(", ".invoke(",
     "medium", "method_call", "autogen", "Replace initiate_chat() method with invoke()"),
    ("sk_param_kernel_to_client", r"kernel=", "client=",
     "high", "parameter", "semantic_kernel", "Replace kernel= parameter with client="),
    ("sk_param_kernel_var_to_client", r"kernel:", "client:",
     "high", "parameter", "semantic_kernel", "Replace kernel: type annotation with client:"),
]

# --- fixed values: validation repositories (name, type, tier, description, priority); all are Python --------
_REPO_HOST = "https://github.com/"
REPO_VALUES = [
    ("microsoft/semantic-kernel", "semantic_kernel", 1,
     "Core SDK - Multi-language (C#, Python, Java). Contains SDK + embedded samples.", "first_pass"),
    ("microsoft/autogen", "autogen", 1,
     "Core Framework - Primary reference for AutoGen patterns", "first_pass"),
    ("Azure-Samples/semantic-kernel-advanced-usage", "semantic_kernel", 2,
     "Enterprise-like usage. Orchestration, hosting, telemetry.", "first_pass"),
    ("Azure-Samples/semantic-kernel-workshop", "semantic_kernel", 2,
     "Tutorial-style, multiple small scenarios. Good for incremental tests.", "second_pass"),
    ("microsoft/semantic-kernel-starters", "semantic_kernel", 2,
     "Self-contained starter projects in .NET, Python, Java.", "third_pass"),
    ("rvinothrajendran/MicrosoftSemanticKernelSamples", "semantic_kernel", 2,
     "Community project, real-world structure. Good for robustness testing.", "third_pass"),
    ("Azure-Samples/agentic-aiops-semantic-kernel", "semantic_kernel", 3,
     "Multi-agent AIOps system using Semantic Kernel and orchestration patterns.", "second_pass"),
    ("Azure-Samples/multi-agent-workshop", "mixed", 3,
     "Multi-agent scenarios using various frameworks. Great for mixed framework detection.", "third_pass"),
    ("Azure-Samples/dream-team", "autogen", 3,
     "Full multi-agent AutoGen app with backend + React UI.", "second_pass"),
    ("microsoft/chat-copilot", "semantic_kernel", 3,
     "Full-stack web application (React + backend) showing SK in production web apps.", "first_pass"),
    ("Azure/semantic-kernel-bot-in-a-box", "semantic_kernel", 3,
     "Enterprise bot template with Azure deployment and extensible architecture.", "first_pass"),
    ("Azure/plan-search-chatbot", "semantic_kernel", 3,
     "Production chatbot incorporating Semantic Kernel for intelligent planning.", "first_pass"),
    ("Azure-Samples/app-service-agentic-semantic-kernel-ai-foundry-agent", "semantic_kernel", 3,
     "Agentic web app with SK + Foundry, production-level architecture.", "first_pass"),
    ("victordibia/designing-multiagent-systems", "autogen", 3,
     "Production multi-agent patterns from published book with real-world implementations.", "first_pass"),
    ("jkmaina/autogen_blueprint", "autogen", 3,
     "Complete guide to building multi-agent AI systems with AutoGen, production patterns.", "first_pass"),
    ("PacktPublishing/Mastering-Multi-Agent-Development-with-AutoGen", "autogen", 3,
     "Advanced patterns and near-production examples from published book.", "second_pass"),
    ("Azure-Samples/semantic-kernel-rag-chat", "semantic_kernel", 2,
     "Enterprise chat implementation with RAG patterns using Semantic Kernel.", "second_pass"),
    ("DavidGSola/pychatbot-semantic-kernel", "semantic_kernel", 2,
     "Chatbot with extensible plugin architecture, community project.", "second_pass"),
    ("30DaysOf/semantic-kernel", "semantic_kernel", 2,
     "Learning project with practical real-world application demonstrating SK capabilities.", "third_pass"),
    ("GregorBiswanger/SemanticFlow", "semantic_kernel", 2,
     "Workflow framework simplifying real-world AI tasks with Semantic Kernel.", "third_pass"),
    ("PacktPublishing/Building-AI-Applications-with-Microsoft-Semantic-Kernel", "semantic_kernel", 2,
     "Comprehensive examples from published book covering various production patterns.", "third_pass"),
]

# key of the rule made from the package mapping; it has no name and takes no part in the search by content
MAPPING_KEY = "sk_import_"


@dataclass(frozen=True)
class Rule:
    """One rewrite rule. `pattern` and `replacement` use Python regex syntax."""

    rule_ord: int
    key: str
    id: str
    pattern: str
    replacement: str
    confidence: str = "medium"
    type: str = "unknown"
    framework: str = ""
    description: str = ""
    source: str = "rule"
    guide_url: str | None = None

    @property
    def jvm_pattern(self) -> str:
        return jvm_pattern(self.pattern)

    @property
    def jvm_replacement(self) -> str:
        return jvm_replacement(self.replacement, self.pattern)

    @property
    def literal(self) -> str:
        return required_literal(self.pattern)


@dataclass(frozen=True)
class RuleSet:
    """An ordered rule table small enough to travel inside the query plan.

    Rules are written by people, so the set is bounded by construction; `from_table` checks that before reading a
    user's table and names the limit it breaks instead of dropping rules.
    """

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    LIMIT = 5000

    def __iter__(self):
        return iter(self.rules)

    def __len__(self):
        return len(self.rules)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.rule_ord, r.key, r.id, r.pattern, r.replacement, r.confidence, r.type, r.framework, r.description,
                 r.source, r.guide_url) for r in self.rules]
        return constant_table(spark, rows, schemas.RULES)

    def by_key(self, key: str) -> Rule | None:
        return next((r for r in self.rules if r.key == key), None)

    def get(self, rule_id: str) -> Rule | None:
        return next((r for r in self.rules if r.id == rule_id), None)

    def plus(self, extra: Iterable[dict | Row]) -> "RuleSet":
        """Add user rules after the existing ones; a rule with a known id replaces that rule in place."""
        merged = {r.id: r for r in self.rules}
        for row in extra:
            values = row.asDict() if isinstance(row, Row) else dict(row)
            values = {k: v for k, v in values.items() if v is not None and k in Rule.__dataclass_fields__}
            values.setdefault("key", values["id"].lower())
            values.pop("rule_ord", None)
            known = merged.get(values["id"])
            values["rule_ord"] = known.rule_ord if known else len(merged)
            merged[values["id"]] = Rule(**values)
        return RuleSet(tuple(merged.values()))

    @classmethod
    def from_table(cls, rules: DataFrame, keep_order: bool = False) -> "RuleSet":
        """`keep_order` keeps the numbers of the table instead of counting from 0, and rules that share an id."""
        rows = rules.orderBy("rule_ord").limit(cls.LIMIT + 1).collect()
        if len(rows) > cls.LIMIT:
            raise ValueError(f"more than {cls.LIMIT} rules: scan the table with scan_rule_table, where rules with a literal have no limit")
        if not keep_order:
            return cls().plus(rows)
        own = [{k: v for k, v in r.asDict().items() if v is not None and k in Rule.__dataclass_fields__} for r in rows]
        return cls(tuple(Rule(**{"key": v["id"].lower(), **v}) for v in own))

    def whole_word(self) -> "RuleSet":
        """The same rules with a word boundary after patterns that end in a word character."""
        return RuleSet(tuple(
            replace(r, pattern=r.pattern + r"\b") if r.pattern[-1:].isalnum() else r for r in self.rules))

    def per_match(self) -> "RuleSet":
        """The same rules with `{name}` bound to the name in each match instead of the file's first class."""
        return RuleSet(tuple(
            replace(r, pattern=r.pattern.replace(r"class \w+", r"class (\w+)", 1), replacement=r.replacement.replace("{name}", r"\1"))
            if "{name}" in r.replacement else r for r in self.rules))


def rule_set(include_mapping_rule: bool = True) -> RuleSet:
    """The built-in catalogue: 35 rules and, unless excluded, the rule made from the package mapping."""
    urls = {framework: url for framework, url, _, _ in GUIDES}
    rules = [
        Rule(i, key, key.upper(), pattern, replacement, confidence, kind, framework, text, "rule", urls.get(framework))
        for i, (key, pattern, replacement, confidence, kind, framework, text) in enumerate(RULE_VALUES)
    ]
    if include_mapping_rule:
        framework, _, old, new, notes = next(m for m in MAPPINGS if m[:2] == ("semantic_kernel", "imports"))
        # the mapping carries no name, so its id ends after the prefix
        rules.append(Rule(len(rules), MAPPING_KEY, MAPPING_KEY.upper(), old, new, "high", "import", framework, notes, "rule",
                          urls[framework]))
    return RuleSet(tuple(rules))


def guides(spark: SparkSession) -> DataFrame:
    return constant_table(spark, GUIDES, "framework string, url string, samples_url string, title string")


def mappings(spark: SparkSession) -> DataFrame:
    return constant_table(
        spark, MAPPINGS, "framework string, mapping string, from_name string, to_name string, notes string")


def best_practices(spark: SparkSession) -> DataFrame:
    return constant_table(spark, enumerate(BEST_PRACTICES, 1), "ord int, practice string")


def reference_urls(spark: SparkSession) -> DataFrame:
    return constant_table(spark, REFERENCE_URLS, "name string, url string")


def repositories(spark: SparkSession, priority: str | None = None) -> DataFrame:
    """Validation repositories, optionally of one priority."""
    rows = [(i, name, f"{_REPO_HOST}{name}.git", kind, "python", tier, text, prio)
            for i, (name, kind, tier, text, prio) in enumerate(REPO_VALUES)]
    table = constant_table(
        spark, rows, "repo_ord int, name string, url string, type string, language string, tier int, description string, "
                     "priority string")
    return table if priority is None else table.filter(F.col("priority") == priority)


def guide_dimension(spark: SparkSession) -> DataFrame:
    """Guides, mappings, best practices and links as one table (kind, framework, name, value)."""
    g = guides(spark).select(F.lit("guide").alias("kind"), "framework", F.col("title").alias("name"), F.col("url").alias("value"))
    m = mappings(spark).select(F.lit("mapping").alias("kind"), "framework", F.col("mapping").alias("name"),
                               F.concat_ws(" -> ", "from_name", "to_name").alias("value"))
    none = F.lit(None).cast("string").alias("framework")
    b = best_practices(spark).select(F.lit("best_practice").alias("kind"), none, F.col("ord").cast("string").alias("name"),
                                     F.col("practice").alias("value"))
    u = reference_urls(spark).select(F.lit("url").alias("kind"), none, "name", F.col("url").alias("value"))
    return g.unionByName(m).unionByName(b).unionByName(u)


def relevant_rules(rules: DataFrame, detections: DataFrame) -> DataFrame:
    """Rules whose id was detected. The ids are made distinct first, so the join sees at most one row per id."""
    return rules.join(detections.select("id").distinct(), "id", "left_semi")
