"""Loan-guarantee risk analytics as Spark DataFrame jobs.

Layers, from the bottom up:

* ``functions``  column expressions (no DataFrame, no session)
* ``sources``    readers, writers, dimension tables, saved models
* ``operators``  DataFrame -> DataFrame transformations
* ``plans``      multi-step jobs: training, scoring, reports
* ``streaming``  the same pricing operators on a stream of applications
* ``catalog``    every operator as a checked query over the test tables
"""

__version__ = "0.1.0"
