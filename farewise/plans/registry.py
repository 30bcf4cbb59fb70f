"""All registered queries; importing a plan module adds its entries."""

from farewise.plans import choices, evaluation, operations, scenarios, streams, trips  # noqa: F401
from farewise.plans.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
