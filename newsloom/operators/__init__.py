"""DataFrame jobs: normalise, deduplicate, classify, match, cluster, score, store, report."""
