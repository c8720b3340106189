"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dualtree, lines, ngram_lm, pivots, topk
from .ann import op9_nearest_neighbours
from .licenses import op8_license_scan
from .lines import op4_line_dedup
from .mixing import op6_mix_sources
from .ngram_lm import op10_lm_scoring
from .packing import op1_best_fit_packing
from .quality import op5_quality_classifier
from .pivots import op12_hard_negatives
from .simhash import op3_simhash_near_dedup
from .dualtree import op13_centroid_clustering
from .tiers import op11_tiered_packing
from .topk import op2_exact_top_k
from .urls import op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_exact_top_k, op3_simhash_near_dedup, op4_line_dedup, op5_quality_classifier,
        op6_mix_sources, op7_url_filter, op8_license_scan, op9_nearest_neighbours, op10_lm_scoring,
        op11_tiered_packing, op12_hard_negatives, op13_centroid_clustering,
    )
}
ORACLE_SQL: dict[str, str] = topk.ORACLE_SQL | lines.ORACLE_SQL | ngram_lm.ORACLE_SQL | pivots.ORACLE_SQL | dualtree.ORACLE_SQL
