"""streaming of strataline."""
