"""Analytics over versioned file-tree snapshots, as DataFrame operators."""
