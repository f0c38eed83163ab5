"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import op7_byte_bpe
from .decontaminate import op6_decontaminate
from .html_text import op8_html_text
from .line_dedup import OP10_SQL, op10_line_dedup
from .pii import op2_pii
from .quality_rules import OP5_SQL, op5_quality_rules
from .secrets import op4_secrets
from .simhash_dedup import op9_simhash_dedup
from .toxicity import op1_toxicity
from .url_rules import OP3_SQL, op3_url_rules

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_url_rules, op4_secrets, op5_quality_rules, op6_decontaminate, op7_byte_bpe, op8_html_text, op9_simhash_dedup, op10_line_dedup)}
SQL = {"op3_url_rules": OP3_SQL, "op5_quality_rules": OP5_SQL, "op10_line_dedup": OP10_SQL}
