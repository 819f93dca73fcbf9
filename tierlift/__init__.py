"""Top-tier association analytics, written as PySpark DataFrame operators.

Vocabulary used throughout: an *entity* holds *items*; a set of two or three
items is a *bundle*; the *metric* is the outcome; entities at or above a high
quantile of the metric carry the boolean *label* ``is_top``; *region* and
*locality* place an entity.
"""

from tierlift.params import DEFAULTS, Thresholds

__all__ = ["DEFAULTS", "Thresholds"]
