"""Syntax facts kept by content: a text that was parsed once, in whatever project or snapshot, is not parsed again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from transmuta import schemas
from transmuta.functions.facts import with_facts
from transmuta.functions.joins import lookup_join, may_be_member
from transmuta.functions.materialize import Written

STORED = f"digest string, facts {schemas.FACTS}"


def stored_facts(spark: SparkSession, store: str) -> DataFrame:
    """digest, facts of the finished parts of the store; a part without its success mark was not finished and is left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/*/_SUCCESS")
    marks = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    parts = [m.getPath().getParent().toString() for m in marks or []]
    rows = spark.read.schema(STORED).parquet(*parts) if parts else spark.createDataFrame([], STORED)
    # two runs at a time may both parse a text; its facts are the same
    return rows.dropDuplicates(["digest"]) if len(parts) > 1 else rows


def refresh(files: DataFrame, store: str) -> None:
    """Parse the contents that the store does not hold, one file for each content, and add them as one part.

    Digests alone are compared with the store. The contents that are missing become a membership filter in the scan, so
    that no other text is shuffled.
    """
    spark = files.sparkSession
    keyed = files.select(F.sha2("content", 256).alias("digest"), "content").filter("content IS NOT NULL")
    missing = Written(keyed.select("digest").distinct().join(stored_facts(spark, store).select("digest"), "digest", "left_anti"), "missing-facts")
    wanted = keyed.filter(may_be_member(missing.df, ["digest"])).groupBy("digest").agg(F.first("content").alias("content")).join(missing.df, "digest", "left_semi")
    with_facts(wanted).select("digest", "facts").write.parquet(f"{store}/part-{uuid.uuid4().hex}")
    missing.drop()


def code_facts(files: DataFrame, store: str) -> DataFrame:
    """repo, path and the facts of each file, as `facts.code_facts` gives them; only contents new to the store are parsed."""
    refresh(files, store)
    keys = files.select("repo", "path", F.sha2("content", 256).alias("digest"))
    found = lookup_join(keys, stored_facts(files.sparkSession, store), ["digest"], ["repo", "path"], "left", most_hot=100)
    return found.select("repo", "path", "facts.*")
