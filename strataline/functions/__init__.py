"""functions of strataline."""
