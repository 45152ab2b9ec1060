"""Incremental ingest: pages that arrive as a stream become a searchable segment a batch (see ``operators.segments``)."""

from ..operators.segments import Segments, ingest, with_ids

__all__ = ["Segments", "ingest", "with_ids"]
