"""Operators of a training-data pipeline: mixing, deduplication, sharding, scans, extraction, tokens, archives.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Every operator takes and returns DataFrames,
reads only the columns it names (others may be there, with any name), and leaves its lineage cuts in the shared
folder of ``spark.checkpoint.dir``.
"""

import importlib

from pyspark import cloudpickle

# Executors need the libraries that a function uses, not this package. ``pieces`` alone keeps its lattice in the
# worker's module between tasks, so it has to be installed there.
for _name in ("bytebpe", "crosstoken", "html", "nearvec", "quality", "shard", "simhash", "warc"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
