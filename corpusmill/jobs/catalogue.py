"""Every registered query with its oracle SQL, gathered from the job modules."""

from __future__ import annotations

from corpusmill.jobs import check_jobs, collection_jobs, evidence_jobs, geo_jobs, ledger_jobs, manifest_jobs, raster_jobs, record_jobs, stream_jobs, text_jobs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (text_jobs, evidence_jobs, manifest_jobs, geo_jobs, ledger_jobs, record_jobs, stream_jobs, collection_jobs, check_jobs, raster_jobs):
    QUERIES.update(_module.jobs.queries)
    ORACLE.update(_module.jobs.oracle)
