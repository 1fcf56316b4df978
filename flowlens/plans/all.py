"""Import every catalog module so the registry is complete."""
from . import catalog, catalog_eval, catalog_fit, catalog_joint, catalog_misc  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
