"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe
from .fingerprints import op1_fingerprints
from .langid import op3_language_id
from .linededup import op4_line_dedup
from .media import op7_media
from .packing import op2_packing
from .quality import op5_quality
from .simhash import op8_simhash
from .suffixes import op9_suffix_dedup
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_packing, op3_language_id, op4_line_dedup, op5_quality, op6_bpe, op7_media, op8_simhash, op9_suffix_dedup, op10_toxicity)
}

#: Hashing, tokenising, learned scores and packing are beyond SQL; the tests hold these queries against brute force.
ORACLE_SQL: dict[str, str] = {}
