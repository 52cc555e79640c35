"""Operators of a training-data pipeline: their queries and, where SQL can express them, the SQL that gives the same rows.

Nothing else in the library imports this subpackage. Its modules are sent to the executors by value, so they needn't be installed there.
"""

from pyspark import cloudpickle

from . import common, components, decontaminate, html_extract, jaccard_join, language_id, license_scan, line_dedup, lm_scoring, mixing, quality_rules, secret_scan, shingles

_MODULES = (decontaminate, html_extract, mixing, secret_scan, jaccard_join, license_scan, language_id, line_dedup, quality_rules, lm_scoring)
for _m in (common, components, shingles, *_MODULES):
    cloudpickle.register_pickle_by_value(_m)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
