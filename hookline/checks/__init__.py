"""Registered queries: each operator over the given tables, with the SQL that must give the same rows."""


def load_all() -> None:
    """Imports every module that registers queries."""
    from . import corpus_queries, text_queries, url_queries  # noqa: F401, I001
    from . import model_queries, profile_queries  # noqa: F401  the models reuse the SQL of others
