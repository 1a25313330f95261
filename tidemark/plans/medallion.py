"""Bronze to silver to gold as a named graph of functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import columns as C
from tidemark.operators import clean, quality, rollups


class Assembly:
    """Tables by name, each a function of those it names as its parameters. A table is built once for a run."""

    def __init__(self) -> None:
        self.made: dict[str, Callable[..., DataFrame]] = {}

    def table(self, function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        self.made[function.__name__] = function
        return function

    def build(self, target: str, given: Mapping[str, DataFrame]) -> DataFrame:
        found = dict(given)

        def get(name: str) -> DataFrame:
            if name not in found:
                function = self.made[name]
                names = function.__code__.co_varnames[: function.__code__.co_argcount]
                found[name] = function(*map(get, names))
            return found[name]

        return get(target)

    def publish(self, spark: SparkSession, given: Mapping[str, DataFrame]) -> None:
        """Every table as a view of its name."""
        for name in self.made:
            self.build(name, given).createOrReplaceTempView(name)


market = Assembly()


@market.table
def silver_demand(bronze_demand: DataFrame) -> DataFrame:
    """Typed, with the guarded ratio, without the rows that break a rule."""
    typed = clean.project(bronze_demand, clean.REGION_SUM)
    return quality.expect_or_drop(clean.require_time(typed, "settlement_date").withColumn("demand_generation_ratio", C.ratio("total_demand_mw", "available_generation_mw")), quality.RULES["silver"])


@market.table
def gold_hourly(silver_demand: DataFrame) -> DataFrame:
    return rollups.demand_rollup(silver_demand, "settlement_date", "region_id", "total_demand_mw", "demand_generation_ratio")


@market.table
def gold_daily(silver_demand: DataFrame) -> DataFrame:
    return rollups.daily_rollup(silver_demand, "settlement_date", "region_id", "total_demand_mw", "net_interchange_mw")


@market.table
def gold_market(silver_demand: DataFrame) -> DataFrame:
    return rollups.market_totals(silver_demand, "settlement_date", "total_demand_mw", "available_generation_mw")
