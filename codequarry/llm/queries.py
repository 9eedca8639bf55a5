"""The queries of this subpackage and the SQL of those that SQL can express."""

from .conversation import op12_conversation_repair
from .decontam import op6_decontamination
from .html_text import op4_html_extraction
from .langid import op10_language_id
from .lloyd import OP13_SQL, op13_vector_codes
from .maxscore import OP11_SQL, op11_top_k_search
from .media import op3_media_columns
from .minhash import OP2_SQL, op2_near_duplicates
from .packing import op8_best_fit_packing
from .pii import op1_pii
from .token_counts import op7_token_counts
from .toxicity import op5_toxicity
from .warc import OP9_SQL, op9_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_near_duplicates,
        op3_media_columns,
        op4_html_extraction,
        op5_toxicity,
        op6_decontamination,
        op7_token_counts,
        op8_best_fit_packing,
        op9_warc,
        op10_language_id,
        op11_top_k_search,
        op12_conversation_repair,
        op13_vector_codes,
    )
}
ORACLE_SQL = {"op2_near_duplicates": OP2_SQL, "op9_warc": OP9_SQL, "op11_top_k_search": OP11_SQL, "op13_vector_codes": OP13_SQL}
