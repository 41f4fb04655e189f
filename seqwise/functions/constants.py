"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES (do not edit): static vocabularies, ID = list position, 0 = <PAD>.
"""

EVENT_NAMES = ["<PAD>", "scroll", "add_to_cart", "viewcontent", "pageview", "search", "purchase"]
DEVICE_OS = ["<PAD>", "android", "ios", "desktop"]
CHANNELS = ["<PAD>", "browser", "app"]
CATEGORIES = ["<PAD>", "books", "beauty", "electronics", "fashion", "sports", "home", "toys",
              "grocery", "auto", "health", "music", "games", "other"]
TRAFFIC_SOURCES = ["<PAD>", "direct", "organic", "paid", "referral", "social"]
# Period of day: 0 night (<6), 1 morning (<12), 2 afternoon (<18), 3 evening.
PERIOD_NAMES = ["night", "morning", "afternoon", "evening"]
# Window length of the training sequences.
WINDOW_SIZE = 20
# Normaliser of the distinct-event-type feature in training (size of EVENT_NAMES).
UNIQUE_TYPES_DIVISOR = 7
# Serving-side variant divides by 10 and uses these constants for the time/session features.
SERVING_UNIQUE_TYPES_DIVISOR = 10
SERVING_TIME_DELTA_CONST = 0.5
SERVING_SESSION_CONST = 1.0
# Churn threshold in hours (strictly greater than).
CHURN_HOURS = 168
# Feature cache time-to-live in seconds.
FEATURE_TTL_SECONDS = 3600
# Event-batch bounds and field length limits for ingest validation.
BATCH_MIN, BATCH_MAX = 1, 1000
EVENT_MAX_LEN = {"event_name": 50, "device_os": 20, "channel": 20, "traffic_source": 20,
                 "category": 50, "product_id": 100}
USER_MAX_LEN = {"phone": 50, "name": 255, "location": 100}
# Number of classes of the recommended-action head.
ACTION_CLASSES = 20

# Dynamic vocabularies start with these two reserved entries.
DYNAMIC_RESERVED = ["<PAD>", "<UNK>"]
DYNAMIC_FEATURES = ["event_name", "device_os", "channel", "traffic_source", "category"]

STATIC_VOCABS = {
    "event_name": EVENT_NAMES,
    "device_os": DEVICE_OS,
    "channel": CHANNELS,
    "category": CATEGORIES,
    "traffic_source": TRAFFIC_SOURCES,
}
