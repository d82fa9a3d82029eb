"""One query per operator over its whole table."""

from __future__ import annotations

import corpus_pipeline
from alertmill.llm import (
    ball_codes,
    contamination,
    line_spread,
    lm,
    mixing,
    ngram_join,
    quality,
    ranked_search,
    secrets,
    sharding,
    sketch_dedup,
    sql,
    suffix_dedup,
    toxicity,
)
from alertmill.llm.registry import register, table


@register("op1_lm_scoring")
def op1_lm_scoring(spark, sf_dir):
    return lm.lm_report(table(spark, sf_dir, "documents"))


@register("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@register("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


@register("op5_sharding")
def op5_sharding(spark, sf_dir):
    return sharding.shard_report(table(spark, sf_dir, "documents"))


@register("op6_decontamination", sql.contamination_sql())
def op6_decontamination(spark, sf_dir):
    return contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op7_quality_rules", sql.quality_sql())
def op7_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@register("op8_line_dedup", sql.line_sql())
def op8_line_dedup(spark, sf_dir):
    return line_spread.line_report(table(spark, sf_dir, "documents"))


@register("op9_mixing", sql.mixing_sql())
def op9_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@register("op10_ngram_join")
def op10_ngram_join(spark, sf_dir):
    return ngram_join.join_report(table(spark, sf_dir, "documents"))


@register("op11_vector_codes", sql.codes_sql())
def op11_vector_codes(spark, sf_dir):
    return ball_codes.code_report(table(spark, sf_dir, "embeddings"))


@register("op12_sketch_dedup")
def op12_sketch_dedup(spark, sf_dir):
    return sketch_dedup.dedup_report(table(spark, sf_dir, "documents"))


@register("op13_ranked_search", sql.search_sql())
def op13_ranked_search(spark, sf_dir):
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
