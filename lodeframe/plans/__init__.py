"""Plans: their models, checks, execution, differences and approval."""
