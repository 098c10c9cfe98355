"""Text projections: lines, trimming, decoding, path parts. Pure column expressions, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from transmuta.functions.arrays import once

# characters at which Python's str.splitlines ends a line, besides \n and \r\n
_LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# characters Python's str.strip removes
PY_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def universal_newlines(content: Column) -> Column:
    """\\r\\n and \\r become \\n, as a text-mode read does."""
    return F.when(
        content.contains("\r"), F.translate(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    ).otherwise(content)


def split_lines(content: Column) -> Column:
    """`content.split('\\n')`: a final empty line is kept."""
    return F.split(content, "\n", -1)


def splitlines(content: Column) -> Column:
    """`content.splitlines()`: no final empty line; empty text has no lines."""
    other = F.translate(F.replace(content, F.lit("\r\n"), F.lit("\n")), _LINE_BREAKS, "\n" * len(_LINE_BREAKS))
    # translate works character by character, so it runs only on texts that have such a break
    unified = F.when(content.rlike(f"[{_LINE_BREAKS}]"), other).otherwise(content)

    def cut_up(u: Column) -> Column:
        body = F.when(u.endswith("\n"), F.substring(u, F.lit(1), F.length(u) - 1)).otherwise(u)
        return F.split(body, "\n", -1)

    # the one-element transform binds the unified text, so that it is made once
    split = F.get(F.transform(F.array(unified), cut_up), F.lit(0))
    return F.when(content == "", F.array().cast("array<string>")).otherwise(split)


def lines(files: DataFrame, convention: str = "splitlines", text_col: str = "content",
          keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """One row per line, numbered from 1."""
    arr = {"splitlines": splitlines, "split": split_lines}[convention](F.col(text_col))
    return files.select(*keys, F.posexplode(arr).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).cast("int").alias("line_no"), "line"
    )


def line_count(content: Column) -> Column:
    """Number of `splitlines` lines."""
    return F.size(splitlines(content)).cast("long")


def strip(col: Column) -> Column:
    """Python `str.strip()`."""
    return F.trim(col, F.lit(PY_SPACE))


def mixed_lines(lines_col: Column, first_n: int | None = None) -> Column:
    """A tab anywhere and a leading space somewhere, in all lines or in the first n."""
    head = lines_col if first_n is None else F.slice(lines_col, 1, first_n)
    return F.exists(head, lambda s: s.contains("\t")) & F.exists(head, lambda s: s.startswith(" "))


def with_line_shape(files: DataFrame, first_n: int | None = None) -> DataFrame:
    """Add `n_lines` and `is_mixed` (tabs and spaces), splitting each text once. first_n: lines looked at for tabs and spaces, None for all."""
    split = once(files, _lines=splitlines(F.col("content")))
    return once(split, n_lines=F.size("_lines").cast("long"), is_mixed=mixed_lines(F.col("_lines"), first_n)).drop("_lines")


def decode_with_fallback(raw: Column) -> Column:
    """UTF-8 text, or the latin-1 reading of bytes that are not UTF-8."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def utf8_valid(raw: Column) -> Column:
    """True when the bytes are UTF-8."""
    return F.is_valid_utf8(raw.cast("string"))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """`PurePath.suffix`: from the last dot of the name, '' for dot files and names without or ending in a dot."""
    name = basename(path)
    ext = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(F.ltrim(name, F.lit(".")).contains("."), ext).otherwise(F.lit(""))


def relative(repo: Column, path: Column) -> Column:
    """The path below its project's root, when the path starts with the project name."""
    return F.when(
        F.startswith(path, F.concat(repo, F.lit("/"))), F.substring(path, F.length(repo) + 2, F.length(path))
    ).otherwise(path)


def any_part(path: Column, names: Sequence[str]) -> Column:
    """Does any component of the path equal one of the names?"""
    return F.arrays_overlap(parts(path), F.array(*[F.lit(n) for n in names]))


def preview_list(items: Column, first: int = 3) -> Column:
    """First items joined by ', ' plus '...' when there are more."""
    return F.concat(
        F.array_join(F.slice(items, 1, first), ", "), F.when(F.size(items) > first, F.lit("...")).otherwise(F.lit(""))
    )


def tail(text: Column, n: int = 5000) -> Column:
    """The last n characters."""
    return F.right(text, F.lit(n))


def path_parts(files: DataFrame) -> DataFrame:
    """Top directory, directory depth, name and suffix of each path below its project root."""
    rel = relative(F.col("repo"), F.col("path"))
    p = parts(rel)
    return files.select(
        "repo", "path",
        F.when(F.size(p) > 1, p[0]).alias("top_dir"),
        (F.size(p) - 1).cast("long").alias("depth"),
        basename(rel).alias("basename"),
        suffix(rel).alias("suffix"),
    )
