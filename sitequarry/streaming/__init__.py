"""Running counts and deduplication over streams of pages and events."""
