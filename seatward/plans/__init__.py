"""Registered queries; importing the modules fills the registry."""

from seatward.plans import contacts, people, stock, territory, timeline, writes  # noqa: F401
from seatward.plans.registry import ORACLES, QUERIES  # noqa: F401
