"""All queries of the library by name, and the SQL that states the same result."""

from trailmill.catalog import ORACLES, QUERIES
from trailmill.queries import contracts, datasets, delivery, evaluation, experiments, machines, policy, precision, readiness, repairs, retrieval, rewards, seeds, state, streams, summaries, text  # noqa: F401, I001

__all__ = ["ORACLES", "QUERIES"]
