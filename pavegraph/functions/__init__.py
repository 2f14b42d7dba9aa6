"""Part of pavegraph; see README.md."""
