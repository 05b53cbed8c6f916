"""sitemill: links and stored pages in, structured site records out, as Spark DataFrame jobs."""

__version__ = "0.1.0"
