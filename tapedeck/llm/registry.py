"""The queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

import uuid

from tapedeck.llm import collocations, ctw, decontaminate, lattice, licenses, near_dup, packing, pii, search, sharding, sql, suffixes, toxicity, windows
from tapedeck.llm.common import shared_dir, table


def op1_ctw(spark, sf_dir):
    return ctw.score(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_passages(spark, sf_dir):
    return windows.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op5_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op6_lattice(spark, sf_dir):
    return lattice.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_suffixes(spark, sf_dir):
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    # a store of its own: its versions hang on these records alone
    return sharding.assign(table(spark, sf_dir, "documents"), store=f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}")


def op10_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op13_dual_tree(spark, sf_dir):
    return search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_ctw, op2_toxicity, op3_decontamination, op4_passages, op5_near_dup, op6_lattice, op7_suffixes, op8_packing, op9_sharding, op10_pii, op11_collocations, op12_licenses, op13_dual_tree)}
SQL: dict[str, str] = {"op5_near_dup": sql.NEAR_DUP, "op11_collocations": sql.COLLOCATIONS, "op12_licenses": sql.licenses(), "op13_dual_tree": sql.SEARCH}
