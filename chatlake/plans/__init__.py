"""Registered query plans: each module has QUERIES and ORACLES."""

from chatlake.plans import archive_queries, chat_queries, message_queries, record_queries, row_queries, shard_queries, view_queries

MODULES = [archive_queries, chat_queries, message_queries, record_queries, row_queries, shard_queries, view_queries]
