from ledgerline.functions.records import (
    encode_order,
    encode_validation,
    history_header,
    is_sane_order,
    parse_json,
    parsed_field,
    spend,
    verdict,
)

__all__ = [
    "encode_order",
    "encode_validation",
    "history_header",
    "is_sane_order",
    "parse_json",
    "parsed_field",
    "spend",
    "verdict",
]
