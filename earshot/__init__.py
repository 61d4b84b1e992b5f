"""Transcript moderation on Spark: rule packs, matching, routing, metering, feeds."""
