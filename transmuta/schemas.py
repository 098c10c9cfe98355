"""Fixed schemas of the tables that pass between operators (DDL strings)."""

FILES = "repo string, path string, content string"
RAW_FILES = "repo string, path string, raw binary"
LINES = "repo string, path string, line_no int, line string"
RULES = (
    "rule_ord int, key string, id string, pattern string, replacement string, confidence string, type string, "
    "framework string, description string, source string, guide_url string"
)
DETECTION = (
    "struct<det_seq:int, id:string, type:string, module:string, class:string, confidence:string, source:string, line:int>"
)
DETECTIONS = (
    "repo string, path string, det_seq int, id string, type string, module string, class string, "
    "confidence string, source string, line int"
)
FACTS = (
    "struct<parse_ok:boolean, err_type:string, err_line:int, err_col:int, err_msg:string, err_text:string, "
    "imports:array<struct<name:string, line:int, seq:int>>, "
    "from_imports:array<struct<module:string, level:int, line:int, seq:int>>, "
    "classes:array<struct<name:string, bases:array<string>, line:int, seq:int>>, "
    "functions:array<struct<name:string, line:int, end_line:int, only_pass:boolean, is_async:boolean, seq:int>>, "
    "asserts:int, max_nesting:int, max_func_lines:int>"
)
ISSUES = (
    "repo string, path string, level string, line_no int, col_no int, error_type string, message string, context string"
)
LINT_ISSUES = (
    "repo string, path string, line_no int, category string, issue_type string, severity string, description string, "
    "current_code string, suggested_fix string, rationale string"
)
DECISIONS = "pattern_id string, decision string, notes string, min_confidence string, last_updated timestamp"
METRIC_COUNTS = (
    "total_files", "files_analyzed", "files_transformed", "files_with_syntax_errors", "files_with_import_errors",
    "files_skipped", "patterns_detected", "patterns_transformed", "transformation_errors", "validation_errors",
)
REPORT_FILE = (
    "repo string, path string, patterns array<struct<det_seq:int, id:string, type:string, module:string, "
    "class:string, confidence:string, source:string, line:int>>"
)
