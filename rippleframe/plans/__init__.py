"""Queries over the driver's tables."""


def every() -> tuple[dict, dict]:
    """All queries and their SQL."""
    from . import catalogue, codec_queries, structure_queries  # noqa: F401 (they register theirs)

    return catalogue.QUERIES, catalogue.ORACLE_SQL
