"""Conversation-log analytics on Spark: ingest, table, conversation, vector and augmentation operators."""
