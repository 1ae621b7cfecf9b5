"""The three end-to-end flows: audit, cleaned splits, re-scoring."""
