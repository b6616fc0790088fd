"""Sources: folders of files, captured pages, evaluation sets."""
