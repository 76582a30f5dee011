"""Part of casegraph."""
