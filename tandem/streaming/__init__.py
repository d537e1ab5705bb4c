"""Progress and review as streams."""
