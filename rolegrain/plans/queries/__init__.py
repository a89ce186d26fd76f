"""Queries over the given tables, one or more per operator."""

from . import applications, boards, eligibility, filters, forms, ranking, requirements, sources, text  # noqa: F401
from .bindings import QUERIES, SQL  # noqa: F401
