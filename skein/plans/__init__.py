"""Registered queries; importing this package fills the registry."""

from skein.plans import audit, codegraph, graph, incremental, metrics, ownership, rendering, retrieval, sources  # noqa: F401
