"""The queries opN_<name> and the DuckDB SQL that some of them are held against."""

from __future__ import annotations

from keylog.llm import decontaminate, license_scan, ngram_join, packing, quality_rules, secret_scan, sharding, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_warc": warc.op3_warc,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.OP1_SQL,
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
}
