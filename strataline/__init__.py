"""Strataline: opportunity analytics and corpus preparation as Spark plans."""
