"""SQL text, fluent builders, batches and transactions, all of which become one Catalyst plan."""
