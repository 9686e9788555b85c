"""The case view and the queries; importing the package registers all of them."""

from casewright.plans import queries_more, queries_records, queries_tables, queries_texts  # noqa: F401
