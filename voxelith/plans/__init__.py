"""Named queries over the carrier tables, with their SQL twins."""
