"""Layer plans: bronze loads, silver conformance, gold star schema, marts and audits."""
