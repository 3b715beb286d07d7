"""Security-log analytics as Spark jobs: ingest, detection rules, signatures, timelines, triage."""
