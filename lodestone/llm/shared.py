"""The shared folder of the library, and lineage cut there."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.sources.shared import folder, new_folder, written

__all__ = ["cut", "folder", "new_folder", "written"]


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from then on."""
    folder(df.sparkSession)
    return df.checkpoint()
