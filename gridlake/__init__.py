"""gridlake: table, catalogue and gridded-array analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from gridlake.frame import Frame  # noqa: E402
from gridlake.session import session  # noqa: E402
from gridlake.workspace import Workspace  # noqa: E402

__all__ = ["Frame", "Workspace", "open_frame", "session"]


def open_frame(spark, path, **options):
    """Open a CSV, array, raster, columnar or folder path as a :class:`Frame`."""
    from gridlake.sources.registry import open_path

    return open_path(spark, path, **options)
