"""Block tables: writing, pruned reading, compressed layers."""
