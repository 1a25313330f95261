"""Report tables: record types and typed columns.

All columns are nullable. They bind to a file by the names in its header row: extra columns are ignored, missing ones
are null.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Market regions (fixed values).
REGIONS = ("NSW1", "QLD1", "SA1", "VIC1", "TAS1")

TIMESTAMP, STRING, DOUBLE = T.TimestampType(), T.StringType(), T.DoubleType()

# Table names, record types and columns of the published report format.
_TABLES: dict[str, tuple[tuple[str, str], dict[str, T.DataType]]] = {
    "DISPATCHREGIONSUM": (
        ("DISPATCH", "REGIONSUM"),
        {
            "SETTLEMENTDATE": TIMESTAMP,
            "RUNNO": STRING,
            "REGIONID": STRING,
            "DISPATCHINTERVAL": STRING,
            "INTERVENTION": STRING,
            "TOTALDEMAND": DOUBLE,
            "AVAILABLEGENERATION": DOUBLE,
            "AVAILABLELOAD": DOUBLE,
            "DEMANDFORECAST": DOUBLE,
            "DISPATCHABLEGENERATION": DOUBLE,
            "DISPATCHABLELOAD": DOUBLE,
            "NETINTERCHANGE": DOUBLE,
        },
    ),
    "DISPATCHPRICE": (
        ("DISPATCH", "PRICE"),
        {
            "SETTLEMENTDATE": TIMESTAMP,
            "RUNNO": STRING,
            "REGIONID": STRING,
            "DISPATCHINTERVAL": STRING,
            "INTERVENTION": STRING,
            "RRP": DOUBLE,
            "EEP": DOUBLE,
            "ROP": DOUBLE,
            "APCFLAG": STRING,
            "MARKETSUSPENDEDFLAG": STRING,
        },
    ),
    "TRADINGPRICE": (
        ("TRADING", "PRICE"),
        {
            "SETTLEMENTDATE": TIMESTAMP,
            "RUNNO": STRING,
            "REGIONID": STRING,
            "PERIODID": STRING,
            "RRP": DOUBLE,
            "EEP": DOUBLE,
            "INVALIDFLAG": STRING,
        },
    ),
    "DISPATCH_UNIT_SCADA": (
        ("DISPATCH", "UNIT_SCADA"),
        {
            "SETTLEMENTDATE": TIMESTAMP,
            "DUID": STRING,
            "SCADAVALUE": DOUBLE,
            "LASTCHANGED": TIMESTAMP,
        },
    ),
    "ROOFTOP_PV_ACTUAL": (
        ("ROOFTOP", "ACTUAL"),
        {
            "INTERVAL_DATETIME": TIMESTAMP,
            "REGIONID": STRING,
            "POWER": DOUBLE,
            "QI": DOUBLE,
            "TYPE": STRING,
            "LASTCHANGED": TIMESTAMP,
        },
    ),
    "P5MIN_REGIONSOLUTION": (
        ("P5MIN", "REGIONSOLUTION"),
        {
            "RUN_DATETIME": TIMESTAMP,
            "INTERVENTION": STRING,
            "INTERVAL_DATETIME": TIMESTAMP,
            "REGIONID": STRING,
            "RRP": DOUBLE,
            "ROP": DOUBLE,
            "EXCESSGENERATION": DOUBLE,
            "TOTALDEMAND": DOUBLE,
            "AVAILABLEGENERATION": DOUBLE,
            "AVAILABLELOAD": DOUBLE,
            "DEMANDFORECAST": DOUBLE,
            "DISPATCHABLEGENERATION": DOUBLE,
            "DISPATCHABLELOAD": DOUBLE,
            "NETINTERCHANGE": DOUBLE,
            "LASTCHANGED": TIMESTAMP,
        },
    ),
    "DISPATCH_REGION": (
        ("DREGION", ""),
        {
            "SETTLEMENTDATE": TIMESTAMP,
            "RUNNO": STRING,
            "REGIONID": STRING,
            "INTERVENTION": STRING,
            "RRP": DOUBLE,
            "EEP": DOUBLE,
            "ROP": DOUBLE,
            "APCFLAG": STRING,
            "MARKETSUSPENDEDFLAG": STRING,
            "TOTALDEMAND": DOUBLE,
            "DEMANDFORECAST": DOUBLE,
            "DISPATCHABLEGENERATION": DOUBLE,
            "DISPATCHABLELOAD": DOUBLE,
            "NETINTERCHANGE": DOUBLE,
            "AVAILABLEGENERATION": DOUBLE,
            "AVAILABLELOAD": DOUBLE,
            "CLEAREDSUPPLY": DOUBLE,
            "RAISE6SECRRP": DOUBLE,
            "RAISE60SECRRP": DOUBLE,
            "RAISE5MINRRP": DOUBLE,
            "LOWER6SECRRP": DOUBLE,
            "LOWER60SECRRP": DOUBLE,
            "LOWER5MINRRP": DOUBLE,
        },
    ),
    "DISPATCH_INTERCONNECTOR": (
        ("DINT", ""),
        {
            "SETTLEMENTDATE": TIMESTAMP,
            "RUNNO": STRING,
            "INTERCONNECTORID": STRING,
            "INTERVENTION": STRING,
            "METEREDMWFLOW": DOUBLE,
            "MWFLOW": DOUBLE,
            "MWLOSSES": DOUBLE,
            "MARGINALVALUE": DOUBLE,
            "VIOLATIONDEGREE": DOUBLE,
            "IMPORTLIMIT": DOUBLE,
            "EXPORTLIMIT": DOUBLE,
            "MARGINALLOSS": DOUBLE,
            "EXPORTGENCONID": STRING,
            "IMPORTGENCONID": STRING,
        },
    ),
    "DISPATCH_INTERCONNECTOR_TRADING": (
        ("TINT", ""),
        {
            "SETTLEMENTDATE": TIMESTAMP,
            "RUNNO": STRING,
            "INTERCONNECTORID": STRING,
            "METEREDMWFLOW": DOUBLE,
            "MWFLOW": DOUBLE,
            "MWLOSSES": DOUBLE,
        },
    ),
    "P5MIN_INTERCONNECTORSOLN": (
        ("P5MIN", "INTERCONNECTORSOLN"),
        {
            "RUN_DATETIME": TIMESTAMP,
            "INTERVENTION": STRING,
            "INTERCONNECTORID": STRING,
            "INTERVAL_DATETIME": TIMESTAMP,
            "METEREDMWFLOW": DOUBLE,
            "MWFLOW": DOUBLE,
            "MWLOSSES": DOUBLE,
            "MARGINALVALUE": DOUBLE,
            "EXPORTLIMIT": DOUBLE,
            "IMPORTLIMIT": DOUBLE,
            "LASTCHANGED": TIMESTAMP,
        },
    ),
    "BIDPEROFFER_D": (
        ("BID", "BIDPEROFFER_D"),
        {
            "SETTLEMENTDATE": TIMESTAMP,
            "DUID": STRING,
            "BIDTYPE": STRING,
            "BIDSETTLEMENTDATE": TIMESTAMP,
            "OFFERDATE": TIMESTAMP,
            "PERIODID": STRING,
            "VERSIONNO": STRING,
            "MAXAVAIL": DOUBLE,
            "FIXEDLOAD": DOUBLE,
            "ROCUP": DOUBLE,
            "ROCDOWN": DOUBLE,
            "ENABLEMENTMIN": DOUBLE,
            "ENABLEMENTMAX": DOUBLE,
            "LOWBREAKPOINT": DOUBLE,
            "HIGHBREAKPOINT": DOUBLE,
            "BANDAVAIL1": DOUBLE,
            "BANDAVAIL2": DOUBLE,
            "BANDAVAIL3": DOUBLE,
            "BANDAVAIL4": DOUBLE,
            "BANDAVAIL5": DOUBLE,
            "BANDAVAIL6": DOUBLE,
            "BANDAVAIL7": DOUBLE,
            "BANDAVAIL8": DOUBLE,
            "BANDAVAIL9": DOUBLE,
            "BANDAVAIL10": DOUBLE,
            "LASTCHANGED": TIMESTAMP,
            "PASAAVAILABILITY": DOUBLE,
            "INTERVAL_DATETIME": TIMESTAMP,
            "DIRECTION": STRING,
            "ENERGYLIMIT": DOUBLE,
            "RECALL_PERIOD": STRING,
        },
    ),
    "BIDDAYOFFER_D": (
        ("BID", "BIDDAYOFFER_D"),
        {
            "SETTLEMENTDATE": TIMESTAMP,
            "DUID": STRING,
            "BIDTYPE": STRING,
            "BIDSETTLEMENTDATE": TIMESTAMP,
            "OFFERDATE": TIMESTAMP,
            "VERSIONNO": STRING,
            "PARTICIPANTID": STRING,
            "DAILYENERGYCONSTRAINT": DOUBLE,
            "REBIDEXPLANATION": STRING,
            "PRICEBAND1": DOUBLE,
            "PRICEBAND2": DOUBLE,
            "PRICEBAND3": DOUBLE,
            "PRICEBAND4": DOUBLE,
            "PRICEBAND5": DOUBLE,
            "PRICEBAND6": DOUBLE,
            "PRICEBAND7": DOUBLE,
            "PRICEBAND8": DOUBLE,
            "PRICEBAND9": DOUBLE,
            "PRICEBAND10": DOUBLE,
            "MINIMUMLOAD": DOUBLE,
            "T1": DOUBLE,
            "T2": DOUBLE,
            "T3": DOUBLE,
            "T4": DOUBLE,
            "NORMALSTATUS": STRING,
            "LASTCHANGED": TIMESTAMP,
            "ENTRYTYPE": STRING,
            "DIRECTION": STRING,
        },
    ),
}


def tables() -> list[str]:
    return list(_TABLES)


def record_type(table: str) -> tuple[str, str]:
    """The two fields that mark a table's rows. An unknown table is an error."""
    if table not in _TABLES:
        raise ValueError(f"unknown report table: {table}")
    return _TABLES[table][0]


def schema(table: str) -> T.StructType:
    record_type(table)
    return T.StructType([T.StructField(name, kind, True) for name, kind in _TABLES[table][1].items()])


def event_time(table: str) -> str:
    """The table's first time column."""
    return next(f.name for f in schema(table) if isinstance(f.dataType, T.TimestampType))


def region_column(table: str) -> str | None:
    return "REGIONID" if "REGIONID" in schema(table).fieldNames() else None
