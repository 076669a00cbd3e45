from ledgerline.sources.kafka import (
    inventory_records,
    kafka_rows,
    read_kafka,
    text_records,
    write_kafka,
)
from ledgerline.sources.keyed_table import KeyedTable
from ledgerline.sources.tables import (
    append_records,
    append_topic,
    read_records,
    read_topic,
    write_state,
)

__all__ = [
    "KeyedTable",
    "append_records",
    "append_topic",
    "inventory_records",
    "kafka_rows",
    "read_kafka",
    "read_records",
    "read_topic",
    "text_records",
    "write_kafka",
    "write_state",
]
