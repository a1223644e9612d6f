"""All registered queries: importing this package fills QUERIES and SQL."""

from gaugeline.catalog.registry import QUERIES, SQL  # noqa: F401
from gaugeline.catalog import records  # noqa: F401
from gaugeline.catalog import outliers  # noqa: F401
from gaugeline.catalog import reports  # noqa: F401
from gaugeline.catalog import features  # noqa: F401
from gaugeline.catalog import clusters  # noqa: F401
from gaugeline.catalog import streams  # noqa: F401
