"""Declared schemas. No schema is inferred from text; Parquet carries its own."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

# Header order of the transactions CSV; names are given by position because the
# file repeats "Account".
RAW_TRANSACTIONS = _struct(
    ("ts", _S),
    ("from_bank", _S),
    ("from_account", _S),
    ("to_bank", _S),
    ("to_account", _S),
    ("amount_received", _D),
    ("receiving_currency", _S),
    ("amount_paid", _D),
    ("payment_currency", _S),
    ("payment_format", _S),
    ("is_laundering", _I),
)

ACCOUNTS = _struct(
    ("bank", _S),
    ("account", _S),
    ("name", _S),
    ("street", _S),
    ("city", _S),
    ("state", _S),
    ("country", _S),
    ("zip", _S),
)

SCORING_REQUEST = _struct(
    ("payment_format", _S),
    ("amount", _D),
    ("from_bank", _S),
    ("to_bank", _S),
    ("currency", _S),
    ("fan_out", _I),
    ("tx_velocity", _I),
)

DRIVER = _struct(("feature", _S), ("shap_val", _D), ("direction", _S))

PREDICTION_LOG = _struct(
    ("ts", T.TimestampNTZType()),
    ("payment_format", _S),
    ("currency", _S),
    ("amount_usd", _D),
    ("from_bank", _S),
    ("to_bank", _S),
    ("fan_out", _I),
    ("tx_velocity", _I),
    ("payment_format_risk", _D),
    ("currency_risk_score", _D),
    ("is_cross_border", _I),
    ("is_near_threshold", _I),
    ("amount_log", _D),
    ("bank_risk_score", _D),
    ("is_in_cycle", _I),
    ("fan_out_degree", _D),
    ("tx_velocity_feat", _D),
    ("risk_score", _D),
    ("verdict", _S),
    ("processing_ms", _I),
)

# Columns a drift reader needs, in the order consumers expect them.
LOOKBACK_COLUMNS = [
    "risk_score",
    "verdict",
    "payment_format",
    "currency",
    "is_cross_border",
    "is_near_threshold",
    "payment_format_risk",
    "currency_risk_score",
    "bank_risk_score",
    "amount_log",
    "fan_out_degree",
    "tx_velocity_feat",
    "is_in_cycle",
    "amount_usd",
    "processing_ms",
]

ENSEMBLE_METADATA = T.StructType(
    [
        T.StructField("boosted_weight", _D),
        T.StructField("forest_weight", _D),
        T.StructField("threshold", _D),
        T.StructField("boosted_ap", _D),
        T.StructField("forest_ap", _D),
        T.StructField("features", T.ArrayType(_S)),
    ]
)
