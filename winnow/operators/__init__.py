"""DataFrame operators: gates, scores, state, batching, reports."""
