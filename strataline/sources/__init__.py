"""sources of strataline."""
