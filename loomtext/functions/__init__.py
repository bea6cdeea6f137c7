"""Part of loomtext."""
