"""All registered queries."""

from tallyspark.queries import ledger  # noqa: F401
from tallyspark.queries import bars  # noqa: F401
from tallyspark.queries import cleaning  # noqa: F401
from tallyspark.queries import anomaly, fraud  # noqa: F401
from tallyspark.queries import news, forum, planning, assets, security  # noqa: F401
from tallyspark.queries import models  # noqa: F401
from tallyspark.queries import streams  # noqa: F401
from tallyspark.queries import payloads, synth  # noqa: F401
from tallyspark.queries import store  # noqa: F401
from tallyspark.queries.registry import QUERIES, Query  # noqa: F401
