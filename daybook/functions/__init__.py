from . import numeric, series  # noqa: F401
