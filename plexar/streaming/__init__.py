"""Events: model, filters, windows, triggers, rules, stores, change capture, and Structured Streaming twins."""
