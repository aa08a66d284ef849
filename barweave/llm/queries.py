"""The corpus operators applied to the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, scratch
from . import audit, backoff, binary, decontaminate, fingerprints, jaccard, language, pack, quality, reputation, substrings, surrogates, trie

#: Key of the surrogates of the query; own data need a key of their own, kept secret.
KEY = "key for the provided synthetic tables"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder: called with a name it reads one, ``path`` says where it lies."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_decontaminate", decontaminate.SQL)
def op1(spark, table):
    return decontaminate.report(table("documents"), table("benchmark"), ["doc_id"])


@query("op2_token_binary")
def op2(spark, table):
    path = scratch(spark, "tokens")
    binary.write(table("documents"), path)
    return binary.read_digest(spark, path)


@query("op5_pack")
def op5(spark, table):
    return pack.pack(table("documents"))


@query("op3_quality")
def op3(spark, table):
    return quality.report(table("documents"), table("labels"))


@query("op7_language")
def op7(spark, table):
    return language.report(table("documents"))


@query("op6_substrings", substrings.SQL)
def op6(spark, table):
    return substrings.report(table("documents"))


@query("op10_jaccard_join", jaccard.SQL)
def op10(spark, table):
    return jaccard.report(table("documents"))


@query("op8_surrogates")
def op8(spark, table):
    return surrogates.replaced(table("documents").select("doc_id", "text"), KEY)


@query("op9_backoff_scores", backoff.SQL)
def op9(spark, table):
    return backoff.report(table("documents"))


@query("op4_fingerprints")
def op4(spark, table):
    return fingerprints.report(table("documents"))


@query("op11_host_reputation", reputation.SQL)
def op11(spark, table):
    return reputation.report(table("pages"))


@query("op12_prefix_trie", trie.SQL)
def op12(spark, table):
    return trie.report(table("conversations"))


@query("op13_filter_audit", audit.SQL)
def op13(spark, table):
    return audit.report(spark, table.path("documents"), table("labels"))
