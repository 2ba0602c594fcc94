"""Company lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.text import strip
from veritrail.operators.keys import first_per_key


def sector_class(sector: Column, classes: dict[str, str] = L.SECTOR_CLASSES, default: str = L.DEFAULT_SECTOR_CLASS) -> Column:
    """Industry class of a sector name: same name, else same but for case, else containment.

    The map is a short literal, so each tier is a chain of comparisons on the row itself;
    within a tier the first map entry wins. A blank sector gets the default.
    """
    bare = F.lower(strip(sector))
    label = F.when(sector.isNull() | (bare == ""), F.lit(default))
    for name, value in classes.items():
        label = label.when(sector == name, F.lit(value))
    for name, value in classes.items():
        label = label.when(bare == name.lower(), F.lit(value))
    for name, value in classes.items():
        key = F.lit(name.lower())
        label = label.when(F.contains(bare, key) | F.contains(key, bare), F.lit(value))
    return label.otherwise(F.lit(default))


def company_search(companies: DataFrame, text: str, n: int | None = None) -> DataFrame:
    """Companies whose name, ticker or sector contains ``text``, whatever the case; ``n`` caps an autocomplete list."""
    needle = F.lower(F.lit(text))
    hit = F.lit(False)
    for column in ("name", "ticker", "sector"):
        hit = hit | F.contains(F.lower(F.coalesce(column, F.lit(""))), needle)
    found = companies.where(hit)
    return found if n is None else found.orderBy("company_id").limit(n)


def sector_list(companies: DataFrame, known: list[str]) -> DataFrame:
    """Known and observed sectors, each once, sorted."""
    spark = companies.sparkSession
    listed = spark.createDataFrame([(s,) for s in known], "sector string")
    observed = companies.where(F.col("sector") != "").select("sector")
    return listed.union(observed).distinct().orderBy("sector")


def distinct_companies(companies: DataFrame) -> DataFrame:
    """One company per ticker: the first listed."""
    return first_per_key(companies, ["ticker"], [F.col("company_id")])
