"""Plans over the supplied tables: panel views and the flagship chain."""
