"""Row-wise and set-wise steps of a tree build."""
