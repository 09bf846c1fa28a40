"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat_formatting
from .decontaminate import OP8_SQL, op8_benchmark_decontamination
from .fingerprint import op4_document_fingerprints
from .language import op2_language_id
from .line_dedup import OP7_SQL, op7_line_dedup
from .mixing import OP13_SQL, op13_source_mixing
from .packing import op5_best_fit_packing
from .periodic import op11_periodic_runs
from .pii import op6_personal_data
from .search import OP12_SQL, op12_ranked_search
from .secrets import OP3_SQL, op3_secret_scan
from .simhash import op10_simhash_near_dedup
from .token_output import op1_token_output

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_language_id,
        op3_secret_scan,
        op4_document_fingerprints,
        op5_best_fit_packing,
        op6_personal_data,
        op7_line_dedup,
        op8_benchmark_decontamination,
        op9_chat_formatting,
        op10_simhash_near_dedup,
        op11_periodic_runs,
        op12_ranked_search,
        op13_source_mixing,
    )
}
ORACLES: dict[str, str] = {
    "op3_secret_scan": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_source_mixing": OP13_SQL,
}
