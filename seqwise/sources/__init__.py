from seqwise.sources.events import (  # noqa: F401
    EVENT_COLUMNS, TRAIN_COLUMNS, adapt_events, load_events, read_events, read_events_range,
    read_users, table_path,
)
