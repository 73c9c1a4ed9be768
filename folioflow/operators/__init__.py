"""DataFrame operators: search, library, shelf, progress, line filters, paging."""
