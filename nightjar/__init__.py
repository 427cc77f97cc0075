"""nightjar: security-event analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (parameters passed in,
no global state, no wall clock). Sub-packages:

* ``sources``   – readers/writers (driver tables, flexible JSON, CSV, node-link graphs, sinks)
* ``functions`` – reusable Column expressions (rules, masks, severities, join helpers)
* ``operators`` – the per-domain operators (sessions, rules, graph, drift, ...)
* ``plans``     – fixture projections and composed pipelines (e.g. ``detect``)
* ``streaming`` – Structured Streaming forms of the pipeline
"""

from nightjar.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
