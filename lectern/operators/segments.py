"""What a block's neighbours say of it, as windows over rows of blocks.

Each takes a frame with a row for each block, the columns that name its document,
and the one that orders its blocks, and adds columns; all windows of a document have
one partitioning and order, so Spark sorts once for them together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Blocks:
    """Windows over the blocks of each document."""

    of: tuple[str, ...]
    order: str

    @property
    def _window(self):
        return W.partitionBy(*self.of).orderBy(self.order)

    def last_before(self, value: Column, where: Column) -> Column:
        """The value of the last block before this one for which a condition holds: of the nearest heading, say."""
        return F.last(F.when(where, value), ignorenulls=True).over(self._window.rowsBetween(W.unboundedPreceding, -1))

    def first_after(self, value: Column, where: Column) -> Column:
        """The value of the first block after this one for which a condition holds."""
        return F.first(F.when(where, value), ignorenulls=True).over(self._window.rowsBetween(1, W.unboundedFollowing))

    def segment(self, begins: Column) -> Column:
        """The number of the segment a block is in; each block that ``begins`` one starts the next, and 0 is what comes before all."""
        return F.sum(F.when(begins, 1).otherwise(0)).over(self._window.rowsBetween(W.unboundedPreceding, 0))

    def run(self, value: Column) -> Column:
        """The number of the run of equal values (nulls are equal) a block is in, from 1."""
        changed = ~value.eqNullSafe(F.lag(value).over(self._window)) | (F.row_number().over(self._window) == 1)
        return self.segment(changed)

    def ahead(self, value: Column, where: Column, blocks: int, most: int) -> Column:
        """Up to ``most`` values of those of the next ``blocks`` blocks for which a condition holds, in order."""
        held = F.collect_list(F.when(where, value)).over(self._window.rowsBetween(1, blocks))
        return F.slice(held, 1, most)


def with_context(rows: DataFrame, blocks: Blocks, is_heading: Column, section: Column, text: Column, body: Column, ahead: int = 8, most: int = 2, letters: int = 220) -> DataFrame:
    """Adds anchor, segment, previous_section, next_section and body_sample to rows of blocks.

    ``anchor`` is the order of the nearest heading before; ``segment`` counts headings; the
    sections are those of the nearest blocks before and after that have another than this one;
    ``body_sample`` has the beginnings of the next body blocks up to the next heading.
    """
    at = F.col(blocks.order)
    rows = rows.withColumns({"anchor": blocks.last_before(at, is_heading), "segment": blocks.segment(is_heading), "_run": blocks.run(section)})
    # of a run all blocks have one section, so what is before its first block is before all
    first = Blocks((*blocks.of, "_run"), blocks.order)
    edge = {"previous_section": F.lag(section).over(blocks._window), "next_section": F.lead(section).over(blocks._window), "_stop": blocks.first_after(at, is_heading)}
    rows = rows.withColumns(edge)
    ends = W.partitionBy(*first.of).orderBy(first.order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"previous_section": F.first("previous_section").over(ends), "next_section": F.last("next_section").over(ends)})
    held = blocks.ahead(F.struct(at.alias("at"), F.substring(text, 1, letters).alias("text")), body, ahead, ahead)
    inside = F.filter(held, lambda x: F.col("_stop").isNull() | (x["at"] < F.col("_stop")))
    return rows.withColumn("body_sample", F.transform(F.slice(inside, 1, most), lambda x: x["text"])).drop("_run", "_stop")
