"""Training-data operators: each module holds one operator, ``entries`` registers their queries."""
