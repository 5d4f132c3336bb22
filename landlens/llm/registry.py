"""Queries of the corpus operators over the driver tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import bpe_encode
from .common import table
from .embeddings import near_vectors
from .filter_audit import filter_audit
from .html_extract import extract_text
from .knn_quality import quality_report
from .lines import line_report
from .mixing import mix_report
from .packing import harmonic_pack
from .phrases import collocations
from .pii import find_pii
from .quality_rules import host_quality
from .simhash import simhash_groups
from .url_filter import judge_urls


def op1_quality_rules(spark, sf_dir):
    return host_quality(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_knn_quality(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))


def op5_bpe_pair_index(spark, sf_dir):
    return bpe_encode(table(spark, sf_dir, "documents"), digest=True)


def op6_harmonic_packing(spark, sf_dir):
    return harmonic_pack(table(spark, sf_dir, "documents"), with_ids=False)


def op7_nn_descent(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_fuzzy_lines(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op11_pivotal_mixing(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"))


def op12_phrase_mining(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = [op1_quality_rules, op2_url_filter, op3_knn_quality, op4_pii, op5_bpe_pair_index, op6_harmonic_packing, op7_nn_descent, op8_fuzzy_lines, op9_simhash, op10_html_extraction, op11_pivotal_mixing, op12_phrase_mining, op13_filter_audit]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    from .oracles import ORACLE

    return dict(ORACLE)
