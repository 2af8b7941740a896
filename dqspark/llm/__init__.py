"""Training-data pipeline operators (deduplication, filtering, formatting, packing).

One module per operator; ``queries`` registers them.  Nothing else in the
library imports this package.
"""
