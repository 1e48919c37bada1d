"""Sources: pages, sitemaps, robots files, search results and form fields as DataFrames."""
