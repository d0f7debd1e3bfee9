"""Table operators: scoring, recall, feeds, catalog maintenance, jobs, profiles, rollups."""
