"""Plan shapes the operators share: selection, prefix sums, hash cuts, skew-safe joins."""
