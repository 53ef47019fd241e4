"""Reusable DataFrame -> DataFrame operators."""

from tillroll.operators.ranking import (exact_percentile, global_row_number, ntile_buckets,
                                        with_surrogate_id)

__all__ = ["exact_percentile", "global_row_number", "ntile_buckets", "with_surrogate_id", "materialize"]


def materialize(df):
    """Cut the lineage of a frame that several passes will read (reliable checkpoint)."""
    from tillroll.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
