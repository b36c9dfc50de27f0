"""State that outlives a run, and streams that read it."""
