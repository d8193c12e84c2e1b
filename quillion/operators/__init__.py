"""DataFrame forms of the engine's operators."""
