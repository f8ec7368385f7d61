"""The queries of this subpackage and their SQL, by registered name."""

from __future__ import annotations

from .decontaminate import op5_decontaminate
from .embedding_dups import op8_embedding_dups
from .html_extract import op10_html_extract
from .jaccard_join import op9_jaccard_join
from .licences import ORACLE as LICENCE_SQL
from .licences import op2_licence_scan
from .mixing import op1_mix
from .paragraph_dedup import op4_paragraph_dedup
from .quality import op7_quality
from .sharding import op3_shard
from .suffix_dedup import op6_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_mix, op2_licence_scan, op3_shard, op4_paragraph_dedup, op5_decontaminate, op6_suffix_dedup, op7_quality, op8_embedding_dups, op9_jaccard_join, op10_html_extract)}
ORACLES: dict[str, str] = {"op2_licence_scan": LICENCE_SQL}
