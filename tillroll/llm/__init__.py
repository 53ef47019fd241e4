"""Corpus preparation: quality rules, URL rules, byte-level BPE, sharding, licence
scans, HTML extraction, SimHash near-duplicates, decontamination, toxicity, secrets, hard
negatives, spelling variants, nearest neighbours.

Nothing else in the library imports this subpackage.  ``registry`` holds the
queries (``opN_<name>``) and their SQL.

Functions that run inside Python workers are pickled by value, so executors need
neither this package nor a shared source folder.
"""

import sys

from pyspark import cloudpickle

from tillroll.llm import (arrowtools, bpe, crf, hard_negatives, html_blocks, line_quality,  # noqa: F401
                          multi_index, secrets, simhash, spelling, toxicity, vectors)

for _m in (arrowtools, bpe, crf, hard_negatives, html_blocks, line_quality, multi_index, secrets, simhash, spelling,
           toxicity, vectors):
    cloudpickle.register_pickle_by_value(sys.modules[_m.__name__])
