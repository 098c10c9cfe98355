"""Detection: which files use the old APIs, from syntax facts (imports, class bases) or from rule regexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from transmuta import schemas
from transmuta.functions.arrays import elements
from transmuta.functions.constants import built_once
from transmuta.functions.facts import names_regex, with_facts
from transmuta.functions.materialize import Written
from transmuta.functions.pyre import jvm_pattern, required_literal
from transmuta.operators.resolve import matches, rule_array
from transmuta.sources import catalog
from transmuta.sources.catalog import RuleSet

# fixed values: module prefixes and base class names that count as a use
PREFIXES = ("semantic_kernel", "sk", "autogen")
CLASS_NAMES = ("Kernel", "KernelFunction", "SemanticFunction", "KernelAgent",
               "ConversableAgent", "AssistantAgent", "UserProxyAgent", "GroupChat")


def _row(seq, sub, ident, kind, module, cls, line) -> Column:
    return F.struct(
        seq.cast("int").alias("seq"), sub.cast("int").alias("sub"), ident.alias("id"), F.lit(kind).alias("type"),
        module.cast("string").alias("module"), cls.cast("string").alias("class"), line.cast("int").alias("line"))


def import_uses(from_imports: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """Detection rows of the from-imports whose module starts with a prefix."""
    hits = F.filter(from_imports, lambda i: reduce(lambda a, b: a | b, [i["module"].startswith(p) for p in prefixes]))
    return F.transform(hits, lambda i: _row(
        i["seq"], F.lit(0), F.concat(F.lit("IMPORT_"), F.translate(F.upper(i["module"]), ".", "_")), "import",
        i["module"], F.lit(None), i["line"]))


def class_uses(classes: Column, names: Sequence[str] = CLASS_NAMES) -> Column:
    """Detection rows of the class bases that are in the name set."""
    rows = F.flatten(F.transform(classes, lambda c: F.transform(c["bases"], lambda b, i: _row(
        c["seq"], i, F.concat(F.lit("CLASS_"), b), "class_inheritance", F.lit(None), b, c["line"]))))
    return F.filter(rows, lambda r: r["class"].isin(list(names)))


@built_once
def detection_array(prefixes: tuple[str, ...] = PREFIXES, names: tuple[str, ...] = CLASS_NAMES) -> Column:
    """All uses in one file in walk order, as an array of detection structs built from the `facts` column."""
    facts = F.col("facts")
    ordered = F.array_sort(F.concat(import_uses(facts["from_imports"], prefixes), class_uses(facts["classes"], names)))
    rows = F.transform(ordered, lambda r, i: F.struct(
        i.cast("int").alias("det_seq"), r["id"].alias("id"), r["type"].alias("type"), r["module"].alias("module"),
        r["class"].alias("class"), F.lit("high").alias("confidence"), F.lit("rule").alias("source"),
        r["line"].alias("line")))
    return F.coalesce(rows, F.array().cast(f"array<{schemas.DETECTION}>"))


def may_use(prefixes: Sequence[str] = PREFIXES, names: Sequence[str] = CLASS_NAMES) -> Column:
    """Only files this accepts can contain a use, so only they are sent to the parser."""
    return F.col("path").endswith(".py") & F.col("content").rlike(names_regex(prefixes, names))


def with_detections(files: DataFrame, prefixes: Sequence[str] = PREFIXES, names: Sequence[str] = CLASS_NAMES,
                    parsed: bool = False) -> DataFrame:
    """Files plus a `detections` array; files that do not parse have none. `parsed` reuses an existing `facts` column."""
    found = files if parsed else with_facts(files, may_use(prefixes, names))
    rows = detection_array(tuple(prefixes), tuple(names))
    if parsed:
        rows = F.when(F.col("path").endswith(".py"), rows).otherwise(F.array().cast(f"array<{schemas.DETECTION}>"))
    return found.withColumn("detections", rows)


def explode_detections(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.inline(elements("detections")))


def discover(files: DataFrame, prefixes: Sequence[str] = PREFIXES, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """One row per use."""
    return explode_detections(with_detections(files, prefixes, names))


def detect_imports(files: DataFrame, prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    found = with_facts(files, may_use(prefixes, ()))
    return found.select("repo", "path", F.inline(import_uses(F.col("facts")["from_imports"], prefixes))).drop("sub", "class")


def detect_class_bases(files: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    found = with_facts(files, may_use((), names))
    return found.select("repo", "path", F.inline(class_uses(F.col("facts")["classes"], names))).drop("sub", "module")


def matching_rules(content: Column, rules: RuleSet) -> Column:
    """Rules whose regex matches the text, in rule order, as an array of (rule_ord, id, type, framework, confidence,
    source).

    The rule table is a constant array filtered per text: no join, no shuffle, and the plan does not grow with the
    number of rules. A byte-level literal test keeps most rules from decoding the text at all.
    """
    hits = F.filter(rule_array(rules), lambda r: matches(content, r))
    fields = ("rule_ord", "id", "type", "framework", "confidence", "source")
    return F.transform(hits, lambda r: F.struct(*[r[f].alias(f) for f in fields]))


def regex_rule_scan(files: DataFrame, rules: RuleSet, text_col: str = "content",
                    keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """One row per (text, rule) where the rule's regex matches."""
    return files.select(*keys, F.inline(matching_rules(F.col(text_col), rules)))


GRAM = 4  # bytes
GRAM_BITS = 1 << 20
_HIT = ("rule_ord", "id", "type", "framework", "confidence", "source")


def _gram_of(literal: str) -> int | None:
    """One of the literal's grams, the one with the least checksum, so that rules with a common beginning are spread."""
    data = literal.encode("utf-8")
    grams = {data[i:i + GRAM] for i in range(len(data) - GRAM + 1)}
    return int.from_bytes(min(grams, key=lambda g: (zlib.crc32(g), g)), "little") if grams else None


def rule_index(rules: DataFrame) -> DataFrame:
    """rules with their pattern in JVM syntax and the gram they are found by, null where no match need hold one; made in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = batch["pattern"].to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([jvm_pattern(p) for p in patterns], pa.string()), pa.array([_gram_of(required_literal(p)) for p in patterns], pa.int64())],
                                             [*batch.schema.names, "jvm", "gram"])
    kept = rules.select(*_HIT, "pattern")
    return kept.mapInArrow(run, f"{kept.schema.toDDL()}, jvm string, gram long")


def _grams_in(known: np.ndarray):
    """Column function: the distinct grams of a text whose place in the filter is set."""
    @F.arrow_udf("array<bigint>")
    def grams(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
            found = np.zeros(0, np.int64)
            if len(b) >= GRAM:
                g = sum(b[k:len(b) - GRAM + 1 + k] << (8 * k) for k in range(GRAM))
                found = np.unique(g[known[g % GRAM_BITS]])
            out.append(found)
        return pa.array(out, pa.list_(pa.int64()))
    return grams


def scan_rule_table(files: DataFrame, rules: DataFrame, text_col: str = "content", keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """`regex_rule_scan` for a rule table of any length, in one scan of the texts.

    Rules are found by an inverted index: a rule stands under one gram of the literal that each of its matches must hold, a text
    looks up the grams it holds, and only these rules' regexes are searched. A filter of GRAM_BITS bits, whatever the
    number of rules, keeps grams of no rule in the scan. Rules whose matches need hold no gram are searched in every text; they must be
    a set that fits a plan (RuleSet.LIMIT), as there is no way to leave any out.
    """
    index = Written(rule_index(rules), "rule-index").df
    known = np.zeros(GRAM_BITS, bool)
    places = index.filter("gram IS NOT NULL").select((F.col("gram") % GRAM_BITS).alias("p"))
    for r in places.groupBy(F.shiftright("p", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits")).collect():  # 32 rows of 4 KB at most
        known[r["block"] << 15:(r["block"] + 1) << 15] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    everywhere = RuleSet.from_table(index.filter("gram IS NULL").drop("jvm", "gram").withColumn("replacement", F.lit("")), keep_order=True)
    rule = F.struct(*_HIT)
    looked_up = F.transform(_grams_in(known)(F.col(text_col)), lambda g: F.struct(g.alias("gram"), F.lit(None).cast(index.select(rule.alias("r")).schema["r"].dataType).alias("rule")))
    searched = F.transform(matching_rules(F.col(text_col), everywhere), lambda r: F.struct(
        F.lit(None).cast("long").alias("gram"), F.struct(*[r[f].alias(f) for f in _HIT]).cast(index.select(rule.alias("r")).schema["r"].dataType).alias("rule")))
    found = files.select(*keys, F.col(text_col).alias("_text"), F.inline(F.concat(looked_up, searched)))
    joined = found.join(index.select("gram", rule.alias("_rule"), "jvm"), "gram", "left")
    hit = F.when(F.col("gram").isNull(), F.col("rule")).when(F.rlike("_text", F.col("jvm")), F.col("_rule"))
    return joined.select(*keys, hit.alias("hit")).filter("hit IS NOT NULL").select(*keys, "hit.*")


def match_counts(files: DataFrame, pattern: str, text_col: str = "content") -> DataFrame:
    """Number of matches of a regex per file."""
    n = F.regexp_count(F.col(text_col), F.lit(jvm_pattern(pattern)))
    return files.select("repo", "path", n.cast("long").alias("n_matches"))


def high_confidence(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("confidence") == "high") & (F.col("source") == "rule"))


def enrich_guidance(detections: DataFrame) -> DataFrame:
    """Add the framework, its guide link and the mapping stored under the detection's type.

    The dimensions are fixed lists of a few rows, so they are constants in the plan rather than joins.
    """
    framework = F.when(F.lower("id").contains("semantic_kernel"), "semantic_kernel").otherwise("autogen")
    urls = F.create_map(*[F.lit(x) for g in catalog.GUIDES for x in (g[0], g[1])])
    notes = F.create_map(*[F.lit(x) for m in catalog.MAPPINGS for x in (f"{m[0]}/{m[1]}", m[4])])
    return detections.withColumn("framework", framework).withColumns({
        "guide_url": urls[F.col("framework")],
        "guidance": F.try_element_at(notes, F.concat_ws("/", "framework", "type")),
    })


def rule_detections(files: DataFrame, rules: RuleSet) -> DataFrame:
    """Detections of a report that names rule ids: AST uses first, then every matching rule of the catalogue."""
    return explode_detections(with_rule_detections(with_detections(files), rules))


def with_rule_detections(files: DataFrame, rules: RuleSet) -> DataFrame:
    """Append the file's matching rules to its `detections` array."""
    offset = F.size("detections")
    extra = F.transform(matching_rules(F.col("content"), rules), lambda r, i: F.struct(
        (i + offset).cast("int").alias("det_seq"), r["id"].alias("id"), r["type"].alias("type"),
        F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("class"),
        r["confidence"].alias("confidence"), r["source"].alias("source"), F.lit(None).cast("int").alias("line")))
    return files.withColumn("detections", F.concat("detections", extra))


def files_for_detections(files: DataFrame) -> DataFrame:
    """Files to transform: those with a detection or, in a project without any, all of its files.

    Only one flag per project is shuffled; the flags come back through a salted join so that a project holding a
    large share of the files is not one task.
    """
    from transmuta.functions.joins import salted_join

    keys = files.select("repo", "path", (F.size("detections") > 0).alias("has_detection"))
    per_repo = keys.groupBy("repo").agg(F.max("has_detection").alias("repo_has_detection"))
    joined = salted_join(keys, per_repo, ["repo"], "inner", spread_by=["path"])
    return joined.filter(F.col("has_detection") | ~F.col("repo_has_detection")).select("repo", "path")
