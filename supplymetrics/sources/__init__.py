from supplymetrics.sources.adapters import Tables  # noqa: F401
from supplymetrics.sources.schemas import GRAIN, SCHEMAS  # noqa: F401
