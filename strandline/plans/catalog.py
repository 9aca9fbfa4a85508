"""Names of the queries, and the SQL that DuckDB holds each against."""

from __future__ import annotations

from ..operators import asof, authors, discovery, ecosystem, engagement, graph, search, sketches, social, surfaces, tags, threads  # noqa: F401
from ..sources import adapters, payloads, read_model, tables  # noqa: F401
from ..streaming import jobs
from .template import REGISTRY, build, oracle

#: Frames that stand for inputs, not operators.
ADAPTERS = ("present", "ev", "notes", "acts", "follow", "payments", "sightings", "posts", "post_now", "hashtags", "links", "chat", "probes", "edges", "tags", "profiles", "relay_lists", "short_words", "settings", "windows", "states", "state_items", "receipts", "replies", "blocked", "seed_config", "seed_before", "post_words", "search_posts", "search_queries", "profile_texts", "profile_queries", "suggested_items", "domain_author_daily", "search_terms", "frequent_words", "tag_counts", "report_types", "post_parents", "relay_documents", "relay_states", "tracked_accounts", "polls", "poll_votes", "badge_awards", "badge_acceptances", "goals", "group_messages", "token_payments", "ln_queries", "direct_messages", "profile_lookups", "reaction_contents")
QUERIES = {name: (lambda spark, sf_dir, name=name: build(spark, sf_dir, name)) for name in REGISTRY if name not in ADAPTERS}
ORACLES = {name: oracle(name) for name in QUERIES}
QUERIES |= graph.QUERIES | sketches.QUERIES | payloads.QUERIES | read_model.QUERIES | tables.QUERIES | jobs.QUERIES
ORACLES |= graph.oracles() | sketches.oracles() | payloads.ORACLES | read_model.ORACLES | tables.oracles() | jobs.ORACLES
