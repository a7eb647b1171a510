"""lexiloom: a Spark-native engine for turning texts and timed captions into ordered study material."""

from lexiloom.session import build_session, cut

__all__ = ["build_session", "cut"]
