"""Part of trailspark."""
