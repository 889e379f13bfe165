"""Structured Streaming: session state, idle heartbeats, fan-out to connections, log streams."""
