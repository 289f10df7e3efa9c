"""Import every query module so that all queries are registered."""

from . import queries_history  # noqa: F401
from . import queries_graph  # noqa: F401
from . import queries_triage  # noqa: F401
from . import queries_metrics  # noqa: F401
from . import queries_sampling  # noqa: F401
from . import queries_extras  # noqa: F401
from . import queries_prep  # noqa: F401
from . import queries_graph2  # noqa: F401
from . import queries_models  # noqa: F401
from . import queries_io  # noqa: F401
