"""Episode analytics on Spark: overlap-aware spans, anchor grids, risk features and models."""

from spanledger.config import Settings
from spanledger.session import build_session, pin_utc

__all__ = ["Settings", "build_session", "pin_utc"]
