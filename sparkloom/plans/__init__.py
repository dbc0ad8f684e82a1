"""Named queries over the test tables, built from the operators."""
