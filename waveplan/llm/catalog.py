"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waveplan.llm.bestfit import op12_bestfit
from waveplan.llm.centroids import OP11_SQL, op11_centroids
from waveplan.llm.language import op3_language
from waveplan.llm.mixing import op7_mixing
from waveplan.llm.neardup import op5_neardup
from waveplan.llm.packing import op6_packing
from waveplan.llm.pii import op8_pii
from waveplan.llm.quality import op4_quality
from waveplan.llm.runs import op13_runs
from waveplan.llm.scoring import op10_scoring
from waveplan.llm.substring import OP1_SQL, op1_substring_dedup
from waveplan.llm.topk import OP2_SQL, op2_topk
from waveplan.llm.warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_topk": op2_topk,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_neardup": op5_neardup,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_scoring": op10_scoring,
    "op11_centroids": op11_centroids,
    "op12_bestfit": op12_bestfit,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_topk": OP2_SQL,
    "op9_warc": OP9_SQL,
    "op11_centroids": OP11_SQL,
}
