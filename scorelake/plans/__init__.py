"""Plan building blocks: skew handling, ordered scans, tile joins, matching."""
