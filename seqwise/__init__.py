"""seqwise: event-sequence analytics on Spark.

Per-user sliding windows, labels, features, vocabularies, feature-store merges,
scoring, metrics and feedback, all expressed as DataFrame / window / streaming
work so that Catalyst plans it and the cluster runs it.
"""

__version__ = "0.1.0"
