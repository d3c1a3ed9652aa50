"""Analysis pipelines, the index build and set algebra."""
