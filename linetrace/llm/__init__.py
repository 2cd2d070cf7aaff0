"""Training-data operators: mixing, licence scans, deduplication, quality rules, token counts,
decontamination, chat formatting, secret scans and HTML extraction.  Nothing outside this
subpackage imports it."""
