"""All registered queries; importing a module registers its queries."""

from checks.registry import ORACLES, QUERIES, expand  # noqa: F401
from checks import vocabulary  # noqa: F401
from checks import cohort_queries  # noqa: F401
from checks import feature_queries  # noqa: F401
from checks import study_queries  # noqa: F401
from checks import model_queries  # noqa: F401
from checks import report_queries  # noqa: F401
