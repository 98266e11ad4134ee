"""Redirect chains as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_cycle(chain: Column) -> Column:
    """Whether a URL occurs twice."""
    return F.size(chain) != F.size(F.array_distinct(chain))


def last_hop(chain: Column) -> Column:
    """The end of a chain; null for an empty one."""
    return F.try_element_at(chain, F.lit(-1))
