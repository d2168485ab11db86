"""Structured Streaming: the page composer as a stateful operator."""
