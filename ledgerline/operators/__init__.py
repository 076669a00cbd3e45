from ledgerline.operators.asof import asof_join, asof_parts
from ledgerline.operators.blocks import split_hot
from ledgerline.operators.custom import (
    SessionAggregate,
    Transformer,
    reduce_per_key,
    session_fold,
    transform,
)
from ledgerline.operators.fold import Fold, RowFold, StockReservation, ordered_fold
from ledgerline.operators.interval import interval_join
from ledgerline.operators.keyed import first_per_key, last_per_key
from ledgerline.operators.routing import route, tag_and_union
from ledgerline.operators.sessions import session_aggregate, session_running

__all__ = [
    "Fold",
    "RowFold",
    "SessionAggregate",
    "StockReservation",
    "Transformer",
    "asof_join",
    "asof_parts",
    "first_per_key",
    "interval_join",
    "last_per_key",
    "ordered_fold",
    "reduce_per_key",
    "route",
    "session_aggregate",
    "session_fold",
    "session_running",
    "split_hot",
    "tag_and_union",
    "transform",
]
