"""Operators for training data: nothing else in the library imports this package."""


def __getattr__(name: str):
    """The registered queries, loaded when asked for, so that Python workers import only what a task needs."""
    if name in ("QUERIES", "ORACLES"):
        from aerolake.llm import queries

        return getattr(queries, name)
    raise AttributeError(name)
