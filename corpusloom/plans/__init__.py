"""Named query plans over the test tables."""
