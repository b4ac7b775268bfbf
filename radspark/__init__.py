"""Part of radspark."""
