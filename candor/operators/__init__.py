"""The engine's verbs, as functions from frames to frames."""
