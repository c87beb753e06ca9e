"""Names for columns that an operator adds and takes away again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores before it as tell it from all columns of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
