"""An index of names by their grams: which names hold a text, start with it, or hold any of many texts, without a scan.

Every name, whatever its case, is filed under each piece of one to GRAM letters in it. A text of GRAM letters or more can
only stand in the names filed under its rarest piece, and these few are compared; a shorter one is a piece itself.
A letter that stands for the start (START) makes a prefix a piece like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Letters of the longest pieces, and what marks the start of a name.
GRAM, START = 3, "\x02"


def pieces(text: Column, n: int) -> Column:
    """The distinct pieces of n letters of a text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def probes(text: Column) -> Column:
    """The pieces by one of which names that hold a text can be found; none for an empty text."""
    short = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) >= GRAM, pieces(text, GRAM)).otherwise(short)


@dataclass
class NameIndex:
    """postings (gram, item, name, marked), in order of gram, and counts (gram, n): stored tables."""

    postings: DataFrame
    counts: DataFrame

    def holding(self, texts: DataFrame) -> DataFrame:
        """(text, item, name) of each name that holds a text of texts (text), whatever the case. An empty or null text is in no name."""
        asked = texts.select("text").distinct().withColumn("low", F.lower("text"))
        grams = asked.select("text", "low", F.explode(probes(F.col("low"))).alias("gram")).join(self.counts, "gram", "left")
        # a piece that no name has rules the text out
        rarest = grams.groupBy("text", "low").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        return rarest.join(self.postings, "gram").where(F.contains("marked", F.col("low"))).select("text", "item", "name")

    def _one(self, low: str) -> DataFrame:
        """(item, name) of the names whose marked form holds a text; one piece is read, by its value."""
        if not low:
            return self.postings.select("item", "name").distinct()
        grams = [low[i : i + GRAM] for i in range(max(1, len(low) - GRAM + 1))]
        known = {r.gram: r.n for r in self.counts.where(F.col("gram").isin(grams)).collect()}  # as many as the text has pieces
        rarest = min(grams, key=lambda g: (known.get(g, 0), g))
        return self.postings.where((F.col("gram") == rarest) & F.contains("marked", F.lit(low))).select("item", "name")

    def containing(self, text: str) -> DataFrame:
        """(item, name) of the names that hold a text, whatever the case."""
        return self._one(text.lower())

    def starting(self, text: str) -> DataFrame:
        """(item, name) of the names that start with a text, whatever the case."""
        return self._one(START + text.lower())


def built(names: DataFrame) -> NameIndex:
    """The index of (item, name); null names are in none. Items may share names."""
    marked = F.concat(F.lit(START), F.lower("name"))
    each = names.where("name IS NOT NULL").select("item", "name", marked.alias("marked"))
    grams = F.array_distinct(F.concat(*[pieces(F.col("marked"), n) for n in range(1, GRAM + 1)]))
    rows = each.select(F.explode(grams).alias("gram"), "item", "name", "marked")
    # sorted, so that a reader of one gram skips the rest
    postings = stored(rows.repartitionByRange("gram").sortWithinPartitions("gram"), "postings")
    return NameIndex(postings, stored(postings.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts"))
