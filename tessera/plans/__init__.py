"""Query specifications, the SQL parser and the builder that make them."""

from .builder import query
from .spec import Agg, Col, Order, QuerySpec, Scalar, Star

__all__ = ["Agg", "Col", "Order", "QuerySpec", "Scalar", "Star", "query"]
