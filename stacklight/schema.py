"""Names of the tables' canonical columns."""

from .sources.files import PRODUCTS, REVIEWS

__all__ = ["PRODUCTS", "REVIEWS"]
