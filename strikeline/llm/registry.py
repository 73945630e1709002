"""The queries of this subpackage and their SQL, by name."""

from strikeline.llm import decontaminate, exact_dedup, html_main, licenses, lm, near_dedup, packing, quality, secrets, warc

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_warc": warc.query,
    "op3_quality": quality.query,
    "op4_pack": packing.query,
    "op5_html_main": html_main.query,
    "op6_near_dedup": near_dedup.query,
    "op7_lm_score": lm.query,
    "op8_secrets": secrets.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_licenses": licenses.query,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_warc": warc.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_licenses": licenses.ORACLE,
}
