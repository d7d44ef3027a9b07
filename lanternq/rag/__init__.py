"""Answers from evidence: a bounded loop of a model, its tools and an audit of what it claims."""
