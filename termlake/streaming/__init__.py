"""Empty on purpose. Documents are kept up to date by a batch sync
(``operators.sync``): a file stream reports new files, but never deletions."""
