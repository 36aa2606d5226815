"""Document-shaped analytics on Spark: a filter and aggregate language over DataFrames,
a versioned store of collections, and live queries."""

from .errors import DocframeError
from .operators.aggregate import aggregate
from .operators.find import count, find
from .operators.update import Update
from .plans.ast import Aggregate, Condition, Filter
from .plans.parser import parse_aggregate, parse_condition, parse_filter, print_aggregate, print_filter
from .plans.template import Params, Template
from .sources.store import Database

__all__ = ["Aggregate", "Condition", "Database", "DocframeError", "Filter", "Params", "Template", "Update", "aggregate", "count", "find", "parse_aggregate", "parse_condition", "parse_filter", "print_aggregate", "print_filter"]
