"""All registered queries."""

from dockspan.queries import evaluation, models, molecules, scoring, sinks_streams, spatial, structures  # noqa: F401
from dockspan.queries.registry import ORACLES, QUERIES  # noqa: F401
