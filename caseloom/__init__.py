"""caseloom: screening analytics as Spark plans."""
