"""Spark-native automatic fuzzy join.

Given a reference table L (nearly duplicate-free), a query table R and a
precision target, learn a many-to-one fuzzy join without labels and run it
as Spark DataFrame jobs.  Public entry points:

* :func:`fuzzyspark.operators.model.fit` / :func:`predict` / :func:`fuzzy_join`
* :func:`fuzzyspark.operators.evaluate.evaluate`
* :mod:`fuzzyspark.operators.validate` (splits, k-fold, CV, grid search)
* :func:`fuzzyspark.operators.pairs.featurize` (distance features only)
"""

from fuzzyspark.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
