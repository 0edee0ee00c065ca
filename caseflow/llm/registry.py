"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from caseflow.llm import sql
from caseflow.llm.collocations import op12_collocations
from caseflow.llm.decontaminate import op6_decontaminate
from caseflow.llm.katz import op4_katz
from caseflow.llm.language_id import op10_language_id
from caseflow.llm.partenum import op9_partenum
from caseflow.llm.radix_dedup import op2_radix_dedup
from caseflow.llm.rlz_dedup import op1_rlz_dedup
from caseflow.llm.secret_scan import op5_secret_scan
from caseflow.llm.sentencepiece import op7_sentencepiece
from caseflow.llm.simhash import op11_simhash
from caseflow.llm.suffix_dedup import op3_suffix_dedup
from caseflow.llm.token_align import op13_token_align
from caseflow.llm.url_filter import op8_url_filter

QUERIES = {
    "op1_rlz_dedup": op1_rlz_dedup,
    "op2_radix_dedup": op2_radix_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_katz": op4_katz,
    "op5_secret_scan": op5_secret_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_url_filter": op8_url_filter,
    "op9_partenum": op9_partenum,
    "op10_language_id": op10_language_id,
    "op11_simhash": op11_simhash,
    "op12_collocations": op12_collocations,
    "op13_token_align": op13_token_align,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op1_rlz_dedup": sql.OP1,
    "op2_radix_dedup": sql.OP2,
    "op4_katz": sql.OP4,
    "op6_decontaminate": sql.OP6,
    "op9_partenum": sql.OP9,
    "op12_collocations": sql.OP12,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
