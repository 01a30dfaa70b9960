"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op7_decontamination
from .html_extract import op4_html_extract
from .importance import op13_importance_resample
from .license_scan import OP10_SQL, op10_license_scan
from .line_dedup import OP2_SQL, op2_line_dedup
from .minhash import op11_minhash_near_dedup
from .ngram_join import op1_ngram_jaccard_join
from .packing import op8_packing
from .quality import op5_quality
from .source_audit import OP12_SQL, op12_source_audit
from .suffix_dedup import op6_suffix_dedup
from .topk_search import OP3_SQL, op3_topk_search
from .toxicity import op9_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_topk_search": op3_topk_search,
    "op4_html_extract": op4_html_extract,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_source_audit": op12_source_audit,
    "op13_importance_resample": op13_importance_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op3_topk_search": OP3_SQL,
    "op10_license_scan": OP10_SQL,
    "op12_source_audit": OP12_SQL,
}
