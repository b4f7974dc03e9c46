"""Named queries over the driver's tables, with their SQL."""

from . import catalog, evaluation, files, recordings, reporting  # noqa: F401
