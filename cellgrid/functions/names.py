"""User-given names inside SQL text."""


def text_literal(name: str) -> str:
    """``name`` as a SQL string, whatever characters it has."""
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def identifier(name: str) -> str:
    """``name`` as a quoted SQL column name."""
    return "`" + name.replace("`", "``") + "`"
