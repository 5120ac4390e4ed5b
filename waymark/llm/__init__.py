"""Training-data pipeline operators: ten corpus operators plus the helpers they share.

Nothing outside this subpackage imports it; the repository works without it.
"""
