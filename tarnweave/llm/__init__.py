"""Operators for preparing training data from the crawl; nothing outside this folder imports them."""
