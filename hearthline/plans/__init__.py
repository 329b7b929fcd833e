"""Queries of the library's own operators over the test tables, and their SQL."""

from hearthline.plans import domain, masks, periods, series, sources, tables  # noqa: F401
from hearthline.plans.registry import QUERIES, SQL  # noqa: F401
