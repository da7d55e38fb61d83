"""operators of strataline."""
