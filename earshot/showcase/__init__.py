"""Queries over the given tables, registered with their checks."""

from earshot.showcase import cells, files, listings, pages, returns, reviews, threads

MODULES = (reviews, returns, listings, threads, cells, pages, files)
