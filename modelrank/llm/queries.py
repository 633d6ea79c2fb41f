"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from functools import wraps

from .ann import op3_multi_index
from .bpe import op8_bpe
from .common import importable
from .decontaminate import OP5_SQL, op5_decontaminate
from .language_id import op9_language_id
from .line_dedup import OP10_SQL, op10_line_dedup
from .pii import op6_pii
from .quality import op7_quality
from .simhash import op1_simhash
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .token_files import op2_token_files


def _ready(f):
    @wraps(f)
    def run(spark, sf_dir):
        importable(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    "op1_simhash": _ready(op1_simhash),
    "op2_token_files": _ready(op2_token_files),
    "op3_multi_index": _ready(op3_multi_index),
    "op4_substring_dedup": _ready(op4_substring_dedup),
    "op5_decontaminate": _ready(op5_decontaminate),
    "op6_pii": _ready(op6_pii),
    "op7_quality": _ready(op7_quality),
    "op8_bpe": _ready(op8_bpe),
    "op9_language_id": _ready(op9_language_id),
    "op10_line_dedup": _ready(op10_line_dedup),
}

ORACLES = {
    "op4_substring_dedup": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op10_line_dedup": OP10_SQL,
}
