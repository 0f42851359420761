from visitledger.functions.scalars import (
    base_id,
    cents,
    first_word,
    half_even,
    money_sum,
    normal_name,
    quarter_hours,
    squeeze_once,
    trim_ws,
)

__all__ = [
    "base_id",
    "cents",
    "first_word",
    "half_even",
    "money_sum",
    "normal_name",
    "quarter_hours",
    "squeeze_once",
    "trim_ws",
]
