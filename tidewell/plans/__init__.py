"""Filters and the plans of filter queries."""
