"""The transactional store and its files."""
