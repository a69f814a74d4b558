"""Streams of events: triggers with state, sessions, working memory that runs out, incremental terms."""
