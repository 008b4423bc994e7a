"""Documents carried through an operator whole, whatever their other columns are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, source and text of the documents, and all their columns as the one column `_doc`."""
    return docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
