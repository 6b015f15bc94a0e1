"""Views over the driver's tables and the named queries; the catalog comes first, since the modules register with it."""

from . import catalog  # noqa: F401
