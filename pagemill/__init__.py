"""Web-corpus analytics as Spark DataFrame jobs.

A corpus is a table ``pages(page_id, url, html)``.  Every operator takes and
returns DataFrames (or Columns), so pipelines chain with ``df.transform``.
"""

from pagemill.options import CrawlOptions

__all__ = ["CrawlOptions"]
