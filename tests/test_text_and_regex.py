import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from transmuta.functions import text
from transmuta.functions.pyre import jvm_pattern, jvm_replacement, required_literal
from transmuta.sources.catalog import rule_set
from transmuta.sources.corpus import glob_regex, match_regex

SAMPLES = ["", "\n", "a", "a\n", "a\n\n", "\n\na", "a\r\nb\rc", "x\x0by\x0cz\x85w\u2028v", "é\n\tü\n", " a \n\tb", "a\x1cb\x1db\x1eb"]


def one(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_line_conventions_equal_python(spark):
    assert one(spark, SAMPLES, text.splitlines) == [s.splitlines() for s in SAMPLES]
    assert one(spark, SAMPLES, text.split_lines) == [s.split("\n") for s in SAMPLES]
    assert one(spark, SAMPLES, text.line_count) == [len(s.splitlines()) for s in SAMPLES]


def test_strip_equals_python(spark):
    values = ["  a b ", "\t\n x\u00a0", "\u3000y\u2003", "", "   ", "z"]
    assert one(spark, values, text.strip) == [v.strip() for v in values]


def test_suffix_equals_pathlib(spark):
    from pathlib import PurePosixPath

    values = ["a/b.py", "a/.gitignore", "a/b.tar.gz", "a/b.", "noext", "x/.a.b", "d.e/f"]
    assert one(spark, values, text.suffix) == [PurePosixPath(v).suffix for v in values]


def test_decoding_falls_back_to_latin1(spark):
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"caf\xe9"),)], "raw binary")
    rows = raw.select(text.decode_with_fallback(F.col("raw")), text.utf8_valid(F.col("raw"))).collect()
    assert [tuple(r) for r in rows] == [("é", True), ("café", False)]


PATTERNS = [(r"\x27(\w)\x27", "<\\1>"), (r"[^[\]]+x", "-"), (r"(?P<a_b>k)(?P=a_b)?", r"\g<a_b>0"), (r"[&&k]+", "&"), (r"x(?=\s|$)", "y"), (r"(?i)KÉ|X", "z"), (r"\\Z", "z"),
            (r"(c)(o)(s)(t)", r"\g<1>0\4"), (r"class (\w+)\(", "class \\1_x("), (r"a.b", "$1"), (r"^x|y$", r"\\"), (r"(?P<n>\d+)\s", r"<\g<n>>"), (r"\bké\b", "K"), (r"\$\{(\w)\}", r"\1")]
TEXTS = ["class Foo(Bar): class Été(X)", "a\nb a b acb", "x\ny", "12 3\u00a04 x", "ké kéa", "cost ${v} $1", "y\n", "x = 'f' [a]x k&k kk \\\\Z"]


@pytest.mark.parametrize("pattern,replacement", PATTERNS)
def test_jvm_dialect_agrees_with_python(spark, pattern, replacement):
    jp, jr = jvm_pattern(pattern), jvm_replacement(replacement, pattern)
    assert one(spark, TEXTS, lambda c: F.regexp_replace(c, jp, jr)) == [re.sub(pattern, replacement, t) for t in TEXTS]
    assert one(spark, TEXTS, lambda c: c.rlike(jp)) == [re.search(pattern, t) is not None for t in TEXTS]


ATOMS = st.sampled_from(["a", "b", r"\x61", r"\.", "[ab]", "[^a]", r"[^[\]]", r"\w", ".", "(a)", "(?:ab)", "(a|b)", r"\b", "K"])
WILD = st.lists(st.tuples(ATOMS, st.sampled_from(["", "", "", "+", "*", "?", "{2}", "{0,1}"])).map(lambda x: x[0] + (x[1] if x[0] != r"\b" else "")), min_size=1, max_size=5).map("".join)


@given(st.text(alphabet="abK.[] ", max_size=14), WILD)
@settings(max_examples=400, deadline=None)
def test_required_literal_of_any_pattern_is_in_every_match(s, pattern):
    for m in re.finditer(pattern, s):
        assert required_literal(pattern) in m.group(0)


@given(st.text(alphabet="abK(.)_ \\n", max_size=12), st.sampled_from([r"Kernel\(", r"a+b", r"ab*K", r"a{2}b", r"[ab]K_", r"(aK)b_", r"\.a\(b"]))
@settings(max_examples=200, deadline=None)
def test_required_literal_is_in_every_match(s, pattern):
    for m in re.finditer(pattern, s):
        assert required_literal(pattern) in m.group(0)


def test_required_literals_of_the_catalogue():
    for rule in rule_set():
        assert rule.literal and len(rule.literal) >= 3
        assert rule.literal in re.sub(r"\\(\W)", r"\1", rule.pattern)


@pytest.mark.parametrize("pattern,path,expected", [
    ("**/__pycache__/*", "a/__pycache__/m.pyc", True), ("**/__pycache__/*", "a/__pycache__/x/m.pyc", False),
    ("**/__pycache__/*", "__pycache__/m.pyc", False), ("*.pyc", "a/b.pyc", True), ("**/test_*", "a/test_x.py", True),
    ("b/*.py", "a/b/c.py", True), ("b/*.py", "ab/c.py", False), ("[!a]*.py", "x/b.py", True)])
def test_exclusions_are_right_anchored(pattern, path, expected):
    from pathlib import PurePosixPath

    assert bool(re.search(match_regex(pattern), path)) is expected
    assert PurePosixPath(path).match(pattern) is expected


@pytest.mark.parametrize("pattern,path,expected", [
    ("**/*.py", "a.py", True), ("**/*.py", "a/b/c.py", True), ("*.py", "a/b.py", False), ("a/**/z.py", "a/z.py", True), ("**/*.py", "a.pyc", False)])
def test_include_globs(pattern, path, expected):
    assert bool(re.search(glob_regex(pattern), path)) is expected
