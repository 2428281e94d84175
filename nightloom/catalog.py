"""Registry of the engine's queries and of the SQL each is compared with."""

from __future__ import annotations

from nightloom.plans import device_queries, frame_queries, geometry_queries, library_queries, pose_queries, session_queries, solver_queries, stacking_queries, stream_queries

MODULES = (stacking_queries, frame_queries, session_queries, solver_queries, geometry_queries, device_queries, stream_queries, library_queries, pose_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "stack_sigma_clip"
