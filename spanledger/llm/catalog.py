"""The registered queries of this subpackage; importing it fills QUERIES."""

from spanledger.llm import queries  # noqa: F401
from spanledger.llm.common import QUERIES

__all__ = ["QUERIES"]
