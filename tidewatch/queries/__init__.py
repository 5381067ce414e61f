"""Every operator applied to the given tables, each with its independent SQL answer."""

from tidewatch.queries.registry import ORACLES, QUERIES  # noqa: F401
from tidewatch.queries import keys, measures, reports, sessions, tables, texts  # noqa: F401,E402
