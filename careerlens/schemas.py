"""Table schemas. A fresh copy is built on each access, since ``add`` mutates."""

from __future__ import annotations

from pyspark.sql import types as T

_DDL = {
    "PAGES": "page_id bigint, url string, html string",
    "POSTINGS": (
        "id string, company string, title string, url string, matched_keywords array<string>, "
        "match_score double, date_found timestamp, applied_status string, notes string, "
        "description string, resume_generated boolean"),
    "RUN_LOG": "ts timestamp, company string, status string, postings_found int, error_message string",
    "TARGETS": "company string, url string, keywords array<string>, check_interval_hours int",
    "SITES": ("site_key string, name string, urls array<string>, "
              "selectors map<string,array<string>>, wait_time int"),
    "SNAPSHOTS": "url string, fetched_at timestamp, html string",
    "CALENDAR": "company string, track string, status string, window string, priority string",
    "PROJECTS": "title string, url string, tech string, bullets array<string>",
    "SKILLS": "category string, ord int, skill string",
    "RECORDS": "company string, title string, url string, text string, location string",
}


def __getattr__(name: str) -> T.StructType:
    if name in _DDL:
        return T.StructType.fromDDL(_DDL[name])
    raise AttributeError(name)
