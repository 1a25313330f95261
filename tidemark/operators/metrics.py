"""A small metric layer (M1-M4): named dimensions and measures over a source, queried in any combination."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MetricView:
    """SQL expressions by name; those of measures aggregate."""

    dimensions: Mapping[str, str]
    measures: Mapping[str, str]

    def query(self, source: DataFrame, dimensions: Sequence[str], measures: Sequence[str], where: str | None = None) -> DataFrame:
        """M2: only what is asked for is computed, so only its columns are read. ``where`` may name dimensions."""
        unknown = [n for n in dimensions if n not in self.dimensions] + [n for n in measures if n not in self.measures]
        if unknown:
            raise ValueError(f"no such dimension or measure: {', '.join(unknown)}")
        if where is not None:
            used = {n: F.expr(e) for n, e in self.dimensions.items() if n in where and n not in source.columns}
            source = source.withColumns(used).where(where).drop(*used)
        return source.groupBy(*[F.expr(self.dimensions[n]).alias(n) for n in dimensions]).agg(*[F.expr(self.measures[n]).alias(n) for n in measures])


PRICE = MetricView(
    {"region_id": "region_id", "date": "to_date(interval_start)", "hour_of_day": "hour(interval_start)", "day_of_week": "date_format(interval_start, 'EEEE')", "is_peak": "hour(interval_start) BETWEEN 17 AND 20", "month": "date_format(interval_start, 'yyyy-MM')"},
    {"avg_price": "avg(rrp)", "price_volatility": "stddev(rrp)", "peak_price": "max(rrp)", "min_price": "min(rrp)", "avg_demand_mw": "avg(demand_mw)", "peak_demand_mw": "max(demand_mw)", "total_demand_mwh": "sum(demand_mw) / 12", "interval_count": "count(*)", "price_range": "max(rrp) - min(rrp)"},
)

#: These two use the functions of tidemark.functions.columns.register_sql_functions.
DEMAND_OPERATIONS = MetricView(
    {"event_hour": "CAST(date_trunc('HOUR', settlement_date) AS TIMESTAMP_NTZ)", "region_id": "region_id", "demand_regime": "demand_regime(total_demand_mw, air_temp_c)"},
    {"interval_count": "count(1)", "avg_demand_mw": "avg(total_demand_mw)", "peak_demand_mw": "max(total_demand_mw)", "avg_temp_c": "avg(air_temp_c)"},
)
PRICE_OPERATIONS = MetricView(
    {"event_hour": "CAST(date_trunc('HOUR', settlement_date) AS TIMESTAMP_NTZ)", "region_id": "region_id", "price_spike_band": "price_spike_band(rrp)"},
    {"interval_count": "count(1)", "avg_rrp": "avg(rrp)", "max_rrp": "max(rrp)", "avg_market_stress_score": "avg(market_stress_score(available_generation_mw - total_demand_mw, net_interchange_mw, rrp))"},
)
