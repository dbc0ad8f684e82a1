"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from .conversation import OP11_SQL, op11_conversation_repair
from .edit_sketch import op1_edit_sketch
from .html_text import op2_html_text
from .language import op9_language
from .lexical import OP12_SQL, op12_lexical_search
from .media import op5_media
from .minhash import OP10_SQL, op10_near_duplicates
from .lm_score import op3_lm_score
from .mixing import OP6_SQL, op6_mixing
from .packing import op4_packing
from .pii import op8_pii
from .quality import op13_quality
from .token_store import op7_token_store

QUERIES = {
    "op1_edit_sketch": op1_edit_sketch,
    "op2_html_text": op2_html_text,
    "op3_lm_score": op3_lm_score,
    "op4_packing": op4_packing,
    "op5_media": op5_media,
    "op6_mixing": op6_mixing,
    "op7_token_store": op7_token_store,
    "op8_pii": op8_pii,
    "op9_language": op9_language,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_quality": op13_quality,
}

#: DuckDB SQL where SQL can express a query.
SQL: dict[str, str] = {"op6_mixing": OP6_SQL, "op10_near_duplicates": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_lexical_search": OP12_SQL}
