"""Tables, catalog, collections, snapshots and lazy readers."""
