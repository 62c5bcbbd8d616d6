"""The registered queries, grouped like the operators."""
