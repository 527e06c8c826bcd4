from supplymetrics.operators.builders import (  # noqa: F401
    apply_rate, calendar, sample_mod, surrogate_key)
from supplymetrics.operators.relational import *  # noqa: F401,F403
