"""All registered queries; importing this package fills the registry."""

from tidewell.workloads import cleaning, learning, metadata, plans, profiling, segments  # noqa: F401
from tidewell.workloads.registry import ORACLES, QUERIES  # noqa: F401
