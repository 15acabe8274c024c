"""Sources: feeds, JSON and CSV that have landed as files or as bodies."""

from rivulet.sources.csv import csv_items, parse_csv_bodies, read_csv
from rivulet.sources.feeds import feed_items, parse_feed_bodies, read_feeds
from rivulet.sources.json import json_items, parse_json_bodies, read_json
from rivulet.sources.landed import Parsed, landed_files

__all__ = [
    "Parsed",
    "csv_items",
    "feed_items",
    "json_items",
    "landed_files",
    "parse_csv_bodies",
    "parse_feed_bodies",
    "parse_json_bodies",
    "read_csv",
    "read_feeds",
    "read_json",
]
