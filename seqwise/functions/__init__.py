from seqwise.functions.constants import (  # noqa: F401
    CATEGORIES, CHANNELS, DEVICE_OS, EVENT_NAMES, PERIOD_NAMES, STATIC_VOCABS,
    TRAFFIC_SOURCES, WINDOW_SIZE,
)
from seqwise.functions.columns import (  # noqa: F401
    encode_static, epoch_us, hour_enc, norm_text, period_of_hour, sigmoid, argmax0,
    floor_days, r9,
)
