"""Relational operators: latest-per-key, anti-joins, gates, quotas, merges."""
