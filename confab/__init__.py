"""confab: conversation analytics on Spark (turns, echoes, tracks, history, intervals)."""

__version__ = "0.1.0"
