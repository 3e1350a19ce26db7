"""Where raw rows come from: part files, reference files, sheets, paged APIs, links in pages."""
