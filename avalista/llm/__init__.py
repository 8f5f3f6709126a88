"""Operators of a training-data pipeline, each a Spark job over whole tables.

``queries`` registers one ``opN_<name>`` query per operator; ``corpus_pipeline.py``
at the top of the repository chains five of them. Nothing outside this subpackage
(but the entry module and the pipeline) imports it.
"""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
