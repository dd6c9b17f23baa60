"""Registered queries and their SQL counterparts."""

from importlib import import_module

_MODULES = ("ticket_queries", "data_queries", "text_queries", "model_queries")


def load_queries():
    from ticketlens.plans.registry import QUERIES
    for module in _MODULES:
        import_module(f"ticketlens.plans.{module}")
    return QUERIES
