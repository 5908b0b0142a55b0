"""Rows of listed taxa, dealt by dataset into as many tasks as their number asks for.

What a task holds (hash tables, sorted rows) then stays the same when the input grows.  A taxon may hold a large share of all rows, so rows are
never dealt by taxon to find the listed ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dealt frame that a task gets on average, and ids that are broadcast.
ROWS, IDS = 200_000, 1_000_000

#: Tasks up to which a shuffle writes row by row (Spark's ``spark.shuffle.sort.bypassMergeThreshold``); for more it holds the rows of a whole file split.
DIRECT = 200


def tasks(*frames: DataFrame, each: int = 1) -> int:
    """Number of tasks for the largest of the frames, whose rows become ``each`` further on; frames dealt into the same number by the same key join where they lie."""
    return max([frames[0].sparkSession.sparkContext.defaultParallelism, *[-(-df.count() * each // ROWS) for df in frames]])


def spread(df: DataFrame, width: int, key: str) -> DataFrame:
    """The rows, dealt by ``key`` into ``DIRECT`` tasks if ``width`` tasks are more than that.

    The deal into ``width`` tasks then holds a 200th of the rows at most, not those of a file split, which may be any number.  A projection
    has to stand between both deals, or Spark makes one of them.
    """
    return df.repartition(DIRECT, key) if width > DIRECT else df


def listed(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are among the ids; a list of over ``IDS`` ids is joined without a broadcast."""
    ids = ids.select(*keys).distinct()
    few = ids.limit(IDS + 1).count() <= IDS
    return df.join(F.broadcast(ids) if few else ids, list(keys), "left_semi")
