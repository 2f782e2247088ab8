"""Declared schemas of the eight input tables. Compact dates and bank codes stay text on read.

Money is DECIMAL(18,2). Where all amounts are known to have at most eight digits, schemas with ``narrow_money`` let Spark
sum them as machine integers (twice as fast); a larger amount then fails the read.
"""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _D = T.LongType(), T.StringType(), T.DoubleType()
_MONEY = _BALANCE = T.DecimalType(18, 2)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


ACCOUNT = _schema(("account_id", _L), ("district_id", _L), ("frequency", _S), ("date", _S))
CARD = _schema(("card_id", _L), ("disp_id", _L), ("type", _S), ("issued", _S))
CLIENT = _schema(("client_id", _L), ("birth_number", _S), ("district_id", _L))
DISP = _schema(("disp_id", _L), ("client_id", _L), ("account_id", _L), ("type", _S))
DISTRICT = _schema(
    ("A1", _L), ("A2", _S), ("A3", _S), ("A4", _L), ("A5", _L), ("A6", _L), ("A7", _L), ("A8", _L),
    ("A9", _L), ("A10", _D), ("A11", _L), ("A12", _S), ("A13", _D), ("A14", _L), ("A15", _S), ("A16", _L),
)
LOAN = _schema(
    ("loan_id", _L), ("account_id", _L), ("date", _S), ("amount", _L), ("duration", _L),
    ("payments", _MONEY), ("status", _S),
)
ORDER = _schema(
    ("order_id", _L), ("account_id", _L), ("bank_to", _S), ("account_to", _L), ("amount", _MONEY),
    ("k_symbol", _S),
)
TRANS = _schema(
    ("trans_id", _L), ("account_id", _L), ("date", _S), ("type", _S), ("operation", _S),
    ("amount", _MONEY), ("balance", _BALANCE), ("k_symbol", _S), ("bank", _S), ("account", _L),
)

TABLES = {
    "account": ACCOUNT, "card": CARD, "client": CLIENT, "disp": DISP,
    "district": DISTRICT, "loan": LOAN, "order": ORDER, "trans": TRANS,
}


def narrow_money(schema: T.StructType, columns: tuple[str, ...] = ("amount", "payments")) -> T.StructType:
    """The schema with single amounts of at most eight digits; balances stay wide."""
    return T.StructType([T.StructField(f.name, T.DecimalType(8, 2) if f.name in columns and isinstance(f.dataType, T.DecimalType) else f.dataType) for f in schema])
