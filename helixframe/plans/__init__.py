"""Named query plans.  Importing this package registers every plan."""

from helixframe.plans import q_cluster, q_contrastive, q_encode, q_io, q_logs, q_quality, q_scores, q_shape, q_stream, q_vectors  # noqa: F401
from helixframe.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
