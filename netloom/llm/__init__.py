"""Training-data operators: each module holds one operator; ``queries`` registers them with their SQL."""
