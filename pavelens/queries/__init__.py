from . import corridor, dataset, detection, geo, manifest, passes, points, scalars, sources, streams, telemetry, trajectory  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
