"""Registered queries of the subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallylane.llm import decontaminate, hamming, packing, pipelined, repeats, secrets, separators, simhash, spelling, surrogates, toxicity, transducer, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op9_secret_scan", secrets.oracle_sql())
def op9(table):
    return secrets.digest(table("documents"))


@query("op2_simhash_components")
def op2(table):
    return simhash.digest(table("documents"))


@query("op10_best_two_fit")
def op10(table):
    return packing.digest(table("documents"))


@query("op4_warc_round_trip", warc.SQL)
def op4(table):
    return warc.digest(table("pages"))


@query("op6_benchmark_leaks")
def op6(table):
    return decontaminate.contaminated(table("documents"), table("benchmark"))


@query("op3_toxicity")
def op3(table):
    return toxicity.digest(table("documents"), table("labels"))


@query("op7_repeated_passages")
def op7(table):
    return repeats.digest(table("documents"))


@query("op1_hamming_top_k", hamming.SQL)
def op1(table):
    return hamming.digest(table("embeddings"))


@query("op5_token_counts")
def op5(table):
    return separators.digest(table("documents"))


@query("op8_surrogates")
def op8(table):
    return surrogates.digest(table("documents"))


@query("op11_spelling_variants", spelling.SQL)
def op11(table):
    return spelling.digest(table("documents"))


@query("op12_bpe_transducer")
def op12(table):
    return transducer.digest(table("documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op13_ranked_search", pipelined.SQL)
def op13(table):
    return pipelined.digest(table("documents"), table("benchmark"))
